"""Template residue, filler text, error pages and notices in the body of emails.

Records made from one template agree but for its slots, so the words around a
slot align them. A variable without any sign of citing is an unfilled slot,
however many copies of its email there are. Where the sentence says that a text
had the variable in it, the words around it decide: if they stand around
different variables it is a slot, if they always hold the same one a citation.
Filler shows itself by standing several times in a row somewhere in the corpus
and is then known wherever it stands alone. Error pages and notices are whole
messages: nothing else but a signature goes with them, and they repeat.

Each task reduces its documents to a few pieces of evidence; only those are
shuffled, by what they align on.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import mail
from strandloom.runtime import materialize

_NAME = r"[A-Za-z_][\w.]*(?: [\w.]+)*"
#: Ways in which template languages and form letters mark a variable.
_SLOT = re.compile(
    "|".join(
        [
            r"\{\{\{?\s*[#>/^&!]?\s*[\w.][\w. ]*?\s*\}?\}\}",
            r"[$#]\{[\w. ]+\}",
            r"\{\$[\w. ]+\}",
            r"[{<]%[=-]?\s*[\w. ]+?\s*%[}>]",
            r"<<\s*[\w. ]+?\s*>>",
            rf"%%{_NAME}%%",
            rf"@@{_NAME}@@",
            rf"\*\|{_NAME}\|\*",
            r"(?<!\w)__[A-Za-z][A-Za-z0-9. ]*(?:_[A-Za-z0-9.]+)*__(?!\w)",
            rf"(?<![\w$])\${_NAME}\$(?!\w)",
            r"%\([\w. ]+\)[sd]",
            rf"\(\({_NAME}\)\)",
            rf"\[\[{_NAME}\]\]",
            r"\[(?:insert|enter|add|fill in|your|tbd|todo)\b[^\[\]]*\]",
            r"\[[A-Z][A-Z_]{2,}(?: [A-Z_]+)*\]",
            r"\[XX[X/. :-]*\]",
            rf"\[{_NAME}\?\]",
            r"\[(?:link|name|date|url)\]",
            r"<(?:insert|enter|add|fill in|your|tbd|todo)\b[^<>@]*>",
            rf"<{_NAME} here>",
            r"\{(?:[A-Za-z_][\w.]*(?: [\w.]+)*|\d)\}",
        ]
    ),
    re.I,
)
_CASED = re.compile(r"\[[A-Za-z]")
_TRIGGER = re.compile(r"[{<\[$%#@*_(]")
_MENTION = re.compile(
    r"\b(?:placeholders?|style guide|syntax|variables?|form letter|merge fields?|mail merge|macros?|preview|diff|export|began with|begins with|explain|joke)\b", re.I
)
#: A text is said to have had the variable in it: words before and after it.
_HAD = re.compile(r"\b(?:letters?|e?-?mails?|messages?|templates?|texts?|drafts?|forms?|leaflets?) (?:still )?(?:had|contained|showed) $", re.I)
_IN_IT = re.compile(r" (?:in|on) (?:it|them)\b", re.I)
_REPORT = re.compile(r"\b(?:says?|said|asks?|asked|reads|shows?|showed|explain|guide|normal|wiki|means|called|why|joke|put|log)\b", re.I)
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»]*[\"”“»]")
_SCRIPTS = re.compile(r"\b(?:java ?scripts?|scripts?|cookies?)\b", re.I)
_DEMAND = re.compile(
    r"\b(?:enable[ds]?|allow(?:ed)?|activ\w*|aktivier\w*|habilit\w*|permit\w*|turn(?:ed)? on|switch(?:ed)? on|required?|requires|needs?|needed|must|disabled|deaktiviert|désactivé\w*|desactivad\w*|does not run|not support\w*)\b", re.I
)
_ERROR = re.compile(
    r"\b(?:http/\d[\d.]* [1-5]\d\d"
    r"|(?:40\d|41\d|42\d|50\d) (?:not found|forbidden|unauthorized|bad|gone|internal|service|gateway|too many|request|error|time-?out)"
    r"|bad gateway|gateway time-?out|internal server error|service (?:is )?(?:temporarily )?(?:down|unavailable)|down for maintenance"
    r"|(?:access|permission) (?:is )?denied|forbidden|page (?:is |was )?(?:gone|not found|introuvable)|(?:not|nicht) (?:be )?(?:found on|gefunden)|gibt es nicht|introuvable|n'existe plus|no (?:se ha )?encontrad\w+|ya no existe"
    r"|fatal error|uncaught exception|unhandled exception|traceback|stack trace|segmentation fault|database (?:error|connection)|connection (?:failed|refused|timed out)"
    r"|too many requests|has been blocked|session (?:has |is )?expired|sesión (?:ha )?(?:expirado|caducado)|sitzung ist abgelaufen|session a expiré|could not be (?:reached|loaded|displayed)|unexpected condition"
    r"|(?:error|erreur|fehler) \d+|error interno|erreur interne|interner (?:server)?fehler|acceso denegado|zugriff verweigert|accès refusé|wartungsarbeiten|en mantenimiento|en maintenance)",
    re.I,
)
_WEAK = re.compile(r"\b(?:sorry|server|browser|reload|refresh|try again|administrator|webmaster|unavailable|sign in|log ?in|address|page|error|display(?:ed)?|view)\b", re.I)
_GREETING = re.compile(r"^(?:dear|hi|hello|hey|hallo|hola|bonjour|salut|guten|liebe|sehr geehrte|good (?:morning|day|evening)|buen|estimad|cher|moin|greetings)", re.I)
_CLOSING = re.compile(
    r"^(?:--|(?:kind |best |warm )?regards|cheers|thanks|thank you|many thanks|sincerely|yours|all the best|best(?: wishes)?|viele gr|mit freundlich|gr[uü]ß|gruss|beste gr|un saludo|saludos|atentamente|cordialement|bien à vous|amicalement|cordial|the operator)", re.I
)
_ATTRIBUTION = re.compile(r"(?:wrote|schrieb\b.*|escribió|a écrit) ?:\s*$|^(?:on|am|le|el) \w{3}, \d|<[^<>\s]+@[^<>\s]+>.{0,20}:\s*$", re.I)
#: Words of the usual Latin filler text.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur".split()
)
_DEFAULT = re.compile(
    r"^(?:(?:(?:your|add|insert|type|enter|put|some)(?: (?:your|some|the|a))? )?(?:text|introduction|content|message|headline|subline|title|body|copy)(?: (?:goes|comes))? here"
    r"|(?:dummy|sample|placeholder) (?:copy|paragraph|text)(?:, [^.!?]*)?|votre texte ici|hier steht ihr text|(?:su|tu) texto aquí)[.!]?$", re.I
)
_KEYBOARD = re.compile(r"^(?:x{3,}|asdf\w*|qwer\w*|tyui\w*|bla+h?|foo|bar|baz|qux|yada)$", re.I)
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_PLAIN = re.compile(r"[^\W\d_]+")


def _masked(s: str) -> str:
    return re.sub(r"\d+", "#", re.sub(r"/\S+", "/", s.lower()))


def _is_slot(m: str) -> bool:
    """Patterns ignore case; a bracketed single word counts only in capitals or as a known name."""
    if m.startswith("[") and not m.startswith("[["):
        inner = m[1:-1]
        return inner.endswith("?") or inner.upper() == inner or bool(re.match(r"(?:insert|enter|add|fill in|your|tbd|todo)\b|(?:link|name|date|url)$", inner, re.I))
    return True


def slots(paragraph: str):
    """Variables left in a paragraph: (words around it, the variable, ``slot``, ``told`` or ``mention``)."""
    if not _TRIGGER.search(paragraph):
        return
    for sentence in _SENTENCE.split(paragraph):
        found = [m for m in _SLOT.finditer(sentence) if _is_slot(m[0])]
        if not found:
            continue
        for m in found:
            before, after = sentence[: m.start()], sentence[m.end():]
            left, right = _SLOT.sub("¤", before).split(), _SLOT.sub("¤", after).split()
            glued = bool(before) and not before[-1].isspace()
            context = _masked(" ".join(left[-2:]) + ("" if glued else " ") + "¤" + ("" if not after or after[0].isspace() else "|") + " ".join([""] + right[:2]))
            code = before[-1:] in tuple("\"'`“„=(/") or after[:1] in tuple("\"'`”/")
            quoted = any(q.start() < m.start() and m.end() <= q.end() for q in _QUOTED.finditer(sentence))
            told = bool(_HAD.search(before) and _IN_IT.match(after))
            yield context, _masked(m[0]), "mention" if code or quoted or _MENTION.search(sentence) else "told" if told else "slot"


def _period(sentences: list[str]) -> list[str]:
    """The sentences that a paragraph repeats in turn, at least twice; empty if it doesn't."""
    fall = [0] * len(sentences)  # the longest border of each beginning
    for i in range(1, len(sentences)):
        k = fall[i - 1]
        while k and sentences[i] != sentences[k]:
            k = fall[k - 1]
        fall[i] = k + (sentences[i] == sentences[k])
    p = len(sentences) - fall[-1] if sentences else 0
    return sentences[:p] if len(sentences) >= 2 * p > 0 else []


def filler(paragraph: str) -> list[tuple[str, str]]:
    """What shows a paragraph to be filler by its words alone, as (key, ``word`` or ``whole``) to count it by."""
    w = [x.lower() for x in _PLAIN.findall(paragraph)]
    latin = [x for x in w if x in _LATIN]
    if len(w) >= 5 and len(latin) >= 0.7 * len(w):
        return [(x, "word") for x in set(latin)]
    if len(w) >= 2 and all(_KEYBOARD.match(x) for x in w):
        return [(" ".join(sorted({re.sub(r"(.)\1+", r"\1", x) for x in w})), "whole")]
    return [(_masked(s), "whole") for s in _SENTENCE.split(paragraph) if _DEFAULT.match(s)]


def _known(sentences: list[str]) -> str:
    """The digest by which a row of sentences is looked up among the learned ones."""
    return hashlib.blake2b(_masked(" ".join(sentences)).encode(), digest_size=8).hexdigest()


def _digest(text: str) -> str:
    return hashlib.blake2b(_masked(text).encode(), digest_size=16).hexdigest()


def _demands(sentence: str) -> bool:
    """Whether a sentence demands scripts or cookies itself; one that reports what somebody says of them doesn't."""
    m = _SCRIPTS.search(sentence)
    return bool(m and _DEMAND.search(sentence) and not _REPORT.search(sentence[: m.start()]))


def page(paragraphs: list[str]) -> tuple[str, str] | None:
    """The template of a whole message of any length whose words are those of a page, and how sure they make it.

    ``strong``: an error or demand in the heading or first sentence, or most
    words in sentences with words of pages. ``weak``: an error or demand
    elsewhere, or only words that often go with pages; then repeats of the
    whole message decide. The template is what the paragraphs with such words
    say, numbers and addresses aside: links and names beneath are its slots.
    """
    core: list[str] = []
    for p in paragraphs:
        if _CLOSING.match(p) or _ATTRIBUTION.search(p):
            break
        core.append(p)
    if not core or _GREETING.match(core[0]) or (core[0][-1] in ",:" and len(core[0].split()) < 5):
        return None
    text = " ".join(core)
    bare = _QUOTED.sub(" ", text)
    sentences = _SENTENCE.split(bare)
    demands = [_demands(s) for s in sentences]
    error = _ERROR.search(bare)
    if any(demands) or error:
        if not any(demands) and _REPORT.search(bare[: error.start()]):
            return None
        telling = [d or bool(_ERROR.search(s) or _WEAK.search(s)) for d, s in zip(demands, sentences)]
        first = _QUOTED.sub(" ", core[0]) if len(core) > 1 else ""
        headed = bool(_ERROR.search(first)) or _demands(first) or demands[0] or bool(_ERROR.search(sentences[0]))
        size = [len(s.split()) for s in sentences]
        sure = headed or 2 * sum(n for n, t in zip(size, telling) if t) > sum(size)
        template = [p for p in core if _ERROR.search(p) or _WEAK.search(p) or _SCRIPTS.search(p)] or core
        return _digest(" ".join(template)) if sure else _digest(text), "strong" if sure else "weak"
    weak = [m.lower() for m in _WEAK.findall(bare)]
    return (_digest(text), "weak") if len(set(weak)) > 1 and 10 * len(weak) >= len(text.split()) and not _REPORT.search(bare) else None


def evidence(text: str | None):
    """Rows (kind, key, value) of one email; see ``find``."""
    for own in mail.own_parts(text):
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t\xa0]*\n", own)]
        paragraphs = [p for p in paragraphs if p]
        found = page(paragraphs)
        if found:
            yield ("page", *found)
        for p in paragraphs:
            for context, variable, kind in slots(p):
                yield (kind, context, variable)
            for key, how in filler(p):
                yield ("filler", key, how)
            sentences = _SENTENCE.split(p)
            turn = _period([s.lower() for s in sentences])
            if turn:
                for s in {_known(turn), *(_known([s]) for s in turn)}:
                    yield ("repeated", s, "")
            elif p[-1] in ".!":
                yield ("alone", _known(sentences), "")


def _rows(batches):
    for batch in batches:
        ids, kinds, keys, values = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k, a, b in set(evidence(text)):
                ids.append(i)
                kinds.append(k)
                keys.append(a)
                values.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(values, pa.string())],
            names=["doc", "kind", "key", "value"],
        )


def gather(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The written table of evidence: ``doc``, ``kind``, ``key``, ``value``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull())
    return materialize(rows.mapInArrow(_rows, "doc long, kind string, key string, value string"), "evidence")


def _bounded(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Sent to all tasks if there are at most so many, else joined by key."""
    return F.broadcast(keys) if keys.count() <= most else keys


def find(found: DataFrame, repeats: int = 3) -> DataFrame:
    """Columns ``doc_id``, ``kind`` and ``aligned`` from the evidence of ``gather``.

    * ``slot``: a variable stands for a value: no quotes, code or talk of
      placeholders go with it. Where a text is said to have had it in it, the
      words around it must hold several variables in the corpus. Neither
      depends on how often an email is copied. ``aligned``: the words around it
      hold several variables, or stand in ``repeats`` emails.
    * ``filler``: filler by its words, or a paragraph of sentences that at least
      ``repeats`` emails hold several times in a row. ``aligned``: the
      sentence, the set of keys or seven in ten of the Latin words recur in
      ``repeats`` emails.
    * ``page``: the whole message is an error page or notice by its words, or
      is a page-like text of any length that at least ``repeats`` emails are
      made of whole. ``aligned``: so many emails share its template.

    What isn't aligned stands too seldom in the corpus to be aligned and is told by
    its words alone. Null and empty texts have no evidence. Equal emails count each. An empty
    table gives an empty result. Texts are read to their end.
    """
    counted = found.filter("kind <> 'alone'").groupBy("kind", "key").agg(F.count_distinct("doc").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    counted = materialize(counted, "templates")
    often = F.col("n") >= repeats
    varied = counted.filter(F.col("kind").isin("slot", "told", "mention")).groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).select("key", (F.col("low") < F.col("high")).alias("varies"), often.alias("often"))
    variables = found.filter(F.col("kind").isin("slot", "told")).join(varied, "key").filter("kind = 'slot' OR varies")
    slot = variables.select("doc", F.lit("slot").alias("kind"), (F.col("varies") | F.col("often")).alias("aligned"))
    learned = _bounded(counted.filter("kind = 'repeated'").filter(often).select("key"))
    said = found.filter(F.col("kind").isin("repeated", "alone")).join(learned, "key", "left_semi").select("doc", F.lit("filler").alias("kind"), F.lit(True).alias("aligned"))
    known = found.filter("kind = 'filler'").join(counted.filter("kind = 'filler'").select("key", often.alias("often")), "key")
    share = F.avg(F.col("often").cast("int"))
    filler_ = known.groupBy("doc", "value").agg(F.when(F.col("value") == "word", share >= 0.7).otherwise(share > 0).alias("aligned")).select("doc", F.lit("filler").alias("kind"), "aligned")
    pages = found.filter("kind = 'page'").join(counted.filter("kind = 'page'").select("key", often.alias("often")), "key").filter("value = 'strong' OR often")
    page_ = pages.select("doc", F.lit("page").alias("kind"), F.col("often").alias("aligned"))
    every = slot.unionByName(said).unionByName(filler_).unionByName(page_)
    return every.groupBy(F.col("doc").alias("doc_id"), "kind").agg(F.max("aligned").alias("aligned"))


def clean(docs: DataFrame, doc_id: str, flagged: DataFrame) -> DataFrame:
    """The documents without the flagged ones, all columns kept."""
    bad = flagged.select(F.col("doc_id").alias("__flagged"))
    return docs.join(bad, F.col(doc_id) == F.col("__flagged"), "left_anti")
