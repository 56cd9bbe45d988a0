import pytest

from strandloom.llm import residue as R

PROSE = "We agreed that Ann will have the report checked by Tuesday at the latest. Nobody has moved the printer since the last delivery came, and the numbers look final to all of us here in the office this week."


def body(text):
    return f"From: a@b\nSubject: {{{{subject}}}}\n\n{text}\n"


CASES = [
    "Dear {{first_name}},\n\n" + PROSE,
    "Hello,\n\nYour request #{job.status} was received on [DATE]. " + PROSE,
    "Hello,\n\n" + PROSE + " Please quote <insert amount> in your answer.",
    "Dear [Your Name],\n\n" + PROSE,
    "Hello,\n\nDetails: %%ROOM%% / *|CITY|*\n\n" + PROSE,
    "Hello,\n\n" + PROSE + "\n\nYour text here. Your text here.",
    "Hello,\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit sed.",
    "asdf asdf asdf\n\nRegards\nAnn",
    "Please enable JavaScript to view this message.\n\nCheers\nAnn",
    "404 Not Found\n\nThe requested address /a/b.html was not found on this server.\n\nHome",
    "Bitte aktivieren Sie JavaScript, um diese Nachricht zu lesen.",
    "Fatal error: uncaught exception in /srv/x.php on\nline 26\n\nOn Mon, 07 Jan 2030 05:16:49 +0530, A <a@b.c> wrote:\n> Hi",
    "Your session has expired. Please sign in again to read this message.",
]
OTHERS = [
    "Hello,\n\n" + PROSE,
    'Hello,\n\nIn the preview the mail began with "Dear {{first_name}}", which we fixed. ' + PROSE,
    "Hello,\n\nOur style guide: write placeholders as <<Name>> or {{name}}, never as $NAME. " + PROSE,
    'Hello,\n\nFor the test run: export RUNS=${HOME}/runs && ls "${RUNS}" gives 3. ' + PROSE,
    "Hello,\n\n" + PROSE + "\n\n> Dear {{first_name}},\n> Your text here. Your text here.",
    "Hello,\n\nSee the set {x_1, x_2} in footnote [1] and table [B], or [PATCH 2/38]. " + PROSE,
    'Hello,\n\nHe asked why the error page says "access denied" to guests. ' + PROSE,
    "Hello,\n\nThe guide says that JavaScript must be enabled for the new page; mine is. " + PROSE,
    "Hello,\n\nA 404 on the wiki page is normal, since Ann moved it. " + PROSE,
    "Hello,\n\nI replaced the lorem ipsum in the leaflet with the text of Ann. " + PROSE,
    'Hello,\n\nThe speaker put "your text here" on slide 9 as a joke. ' + PROSE,
    "Build 9 of branch x-1 failed after 9 s on agent y-2.\n\nTests: 13 run, 4 failed.",
    "Hello,\n\n" + PROSE + "\n\n----- Original Message -----\nFrom: x\n\nDear {{name}},",
    "",
]


def flagged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as kind", "'y' as key")
    return df, R.find(R.gather(df, "doc_id", "text"))


def test_each_kind_alone(spark):
    texts = [body(t) for t in CASES + OTHERS] + [None]
    _, f = flagged(spark, texts)
    assert {r.doc_id for r in f.collect()} == set(range(len(CASES)))


def test_alignment_tells_slots_from_citations(spark):
    cited = [body(f"Hello,\n\nThe old letter had @@NAME@@ in it, number {k}. " + PROSE) for k in range(6)]
    slots = [body(f"Hello,\n\nThe parcel for {v} has left us. " + PROSE) for v in ("@@NAME@@", "{{city}}", "[[room]]", "@@NAME@@")]
    _, f = flagged(spark, cited + slots)
    assert {r.doc_id for r in f.collect()} == {6, 7, 8, 9}


def test_copies_of_one_slot_stay_slots(spark):
    copies = [body("Dear {{first_name}},\n\n" + PROSE)] * 5
    sent = [body(f"Hello,\n\nYour parcel for {{{{city}}}} has left us on day {k}. " + PROSE) for k in range(4)]
    _, f = flagged(spark, copies + sent)
    assert {(r.doc_id, r.kind) for r in f.collect()} == {(k, "slot") for k in range(9)}


def test_variables_that_a_text_had_in_it_are_decided_by_their_neighbours(spark):
    told = [body(f"Hello,\n\nThe old letter had {v} in it, number {k}. " + PROSE) for k, v in enumerate(("@@NAME@@", "@@NAME@@", "{{city}}"))]
    assert flagged(spark, told[:1])[1].count() == 0
    assert {r.doc_id for r in flagged(spark, told)[1].collect()} == {0, 1, 2}


def test_long_pages_that_repeat_are_found(spark):
    trace = "\n".join(f"at app.module{'abcdefghijkl'[k]}.run(Handler.java) called by the dispatcher thread" for k in range(12))
    sent = "We could not deliver your view of this page. Internal server error. " + trace
    headed = "500 Internal Server Error\n\nThe server met a condition. Please contact the administrator. " + trace
    once = "One.\n\nTwo.\n\nThree.\n\nFour.\n\nFive.\n\n" + PROSE + " Access denied."
    texts = [body(sent)] * 3 + [body(headed), body(once), body(sent + " Once more.")]
    _, f = flagged(spark, texts)
    assert {(r.doc_id, r.kind) for r in f.collect()} == {(k, "page") for k in range(4)}


def test_filler_learned_from_repeats(spark):
    texts = [body(f"Hello,\n\n{PROSE}\n\nWrite something nice. Write something nice.") for _ in range(3)]
    texts += [body(f"Hello,\n\n{PROSE}\n\nWrite something nice."), body(f"Hello,\n\n{PROSE}\n\nSee you soon. See you soon.")]
    _, f = flagged(spark, texts)
    assert {(r.doc_id, r.kind) for r in f.collect()} == {(0, "filler"), (1, "filler"), (2, "filler"), (3, "filler")}


def test_the_rest_comes_out_whole(spark):
    texts = [body(CASES[0]), body(OTHERS[0]), body(CASES[8]), body(OTHERS[0]), None]
    df, f = flagged(spark, texts)
    rest = R.clean(df, "doc_id", f)
    assert rest.columns == df.columns and sorted(r.doc_id for r in rest.collect()) == [1, 3, 4]
    empty, none = flagged(spark, [])
    assert none.count() == 0 and R.clean(empty, "doc_id", none).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_long_texts_are_read_to_their_end(spark, n):
    _, f = flagged(spark, [body("Hello,\n\n" + "plain words. " * n + "\n\nDear {{first_name}},")])
    assert {r.kind for r in f.collect()} == {"slot"}


def test_templates_that_recur_are_told_from_lone_ones(spark):
    page = "502 Bad Gateway\n\n{}\n\nBack"
    texts = [body(page.format(f"ngate/1.{k}")) for k in range(3)] + [body("Veuillez activer JavaScript pour afficher ce contenu.")]
    texts += [body(f"Dear {{{{{v}}}}},\n\n{PROSE}") for v in ("name", "first_name")] + [body(PROSE + " The shelf {{shelf}} is empty.")]
    texts += [body("Your text here. Your text here.")] * 3 + [body("asdf asdf asdf")]
    _, f = flagged(spark, texts)
    got = {r.doc_id: (r.kind, r.aligned) for r in f.collect()}
    assert got == {0: ("page", True), 1: ("page", True), 2: ("page", True), 3: ("page", False), 4: ("slot", True), 5: ("slot", True), 6: ("slot", False), 7: ("filler", True), 8: ("filler", True), 9: ("filler", True), 10: ("filler", False)}


def test_pages_and_filler_of_any_length(spark):
    words = " ".join("abcdefghijkl"[k % 12] * (k % 5 + 2) for k in range(50))
    page = f"Something went wrong while the site was loaded. {words} 503 Service Unavailable."
    long_mail = "One.\n\nTwo.\n\nThree.\n\nFour.\n\nFive.\n\n" + (PROSE + " ") * 40 + "Access denied."
    default = "Write something nice about the product that goes with this picture, its colours, its makers and whatever else a reader of the leaflet may want to know."
    texts = [body(page)] * 3 + [body(long_mail)] + [body(f"Hello,\n\n{default} {default}")] * 3 + [body(f"Hello,\n\n{default}")]
    _, f = flagged(spark, texts)
    assert {(r.doc_id, r.kind) for r in f.collect()} == {(k, "page") for k in range(3)} | {(k, "filler") for k in (4, 5, 6, 7)}


def test_periods_of_any_length():
    assert R._period(list("abcdabcd")) == list("abcd") and R._period(list("abcab")) == [] and R._period(["x"]) == [] and R._period([]) == []
    assert R._period(list("aab" * 3 + "a")) == list("aab")
