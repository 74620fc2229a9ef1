import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.line_dedup import WHOLE_LINES_SQL, dedup_lines, dedup_whole_lines


def short_sentences(rng, word, n):
    out = []
    while len(out) < n:
        k = rng.randrange(1, 7)
        out += [word().capitalize(), *(word() for _ in range(k - 1))]
        out[-1] += "."
    return " ".join(out)


def han(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9F00)) + ("。" if i % 13 == 12 else "") for i in range(n))


@pytest.mark.parametrize("kind", ["sentences", "titles", "lines", "han", "lower", "unbroken"])
def test_passages_without_a_long_unit_go(spark, kind):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    make, least = {
        "sentences": (lambda n: short_sentences(rng, word, n), 1.0),
        "titles": (lambda n: " ".join(word().capitalize() for _ in range(n)), 1.0),
        "lines": (lambda n: "\n".join(f"{word()} {word()} {word()}" for _ in range(n // 3)) + "\n", 1.0),
        "han": (lambda n: han(rng, n) + "。", 0.9),
        "lower": (lambda n: " ".join(word() for _ in range(n)), 0.6),
        "unbroken": (lambda n: "".join(word() for _ in range(5 * n)), 0.5),
    }[kind]
    glue = "" if kind in ("han", "unbroken", "lines") else " "
    passage = make(80)
    around = [make(60) for _ in range(4)]
    texts = {i: glue.join((around[2 * i], passage, around[2 * i + 1])) for i in range(2)}
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[0].text == texts[0] and not got[0].removed
    removed = "".join(texts[1][s.start : s.end] for s in got[1].removed)
    assert len(removed) >= least * (len(passage.strip()) - 1) and removed in passage
    if kind != "unbroken":
        assert around[2].strip() in got[1].text and around[3].strip() in got[1].text


def test_repeated_passages_go_and_the_rest_stays(spark, make_text):
    rng = random.Random(9)
    sentence = lambda n: make_text(rng, n).capitalize() + "."
    passage = " ".join(sentence(rng.randrange(9, 14)) for _ in range(6))
    clean = {i: "\n".join(sentence(12) for _ in range(4)) for i in range(6)}
    texts = {10: f"{sentence(11)}\n{passage}\n{sentence(10)}", 11: f"{sentence(9)} {passage} {sentence(9)}", 12: passage, **clean}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert all(got[i].text == clean[i] and not got[i].removed for i in clean)
    assert got[10].text == texts[10]
    assert passage not in got[11].text and got[12].text == ""
    for i in (11, 12):
        removed = "".join(texts[i][s.start : s.end] for s in got[i].removed)
        assert removed == passage
    assert got[11].n_chars == 1


def test_short_lines_may_repeat(spark):
    df = spark.createDataFrame([(i, f"The end.\nOf it.\nA line that only the document {i} holds among all of them here.") for i in range(5)], "doc_id long, text string")
    assert all(not r.removed for r in dedup_lines(df).collect())


def test_line_dedup_against_brute_force(spark, make_text):
    rng = random.Random(12)
    lines = [make_text(rng, 9) for _ in range(6)]
    lines += [make_text(rng, 22).title(), "Die Katze Und Der Hund Im Garten Am Abend", make_text(rng, 4).capitalize() + ". " + make_text(rng, 9).capitalize() + ". No!"]
    lines += [make_text(rng, 4).title() + "! " + make_text(rng, 5), "  " + make_text(rng, 12).upper() + "?"]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6))) for i in range(30)}
    seen, want = set(), {}
    for i in sorted(texts):
        kept = []
        for line in texts[i].split("\n"):
            if " ".join(line.lower().split()) not in seen:
                kept.append(line.strip())
            seen.add(" ".join(line.lower().split()))
        want[i] = kept
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: [x.strip() for x in r.text.split("\n") if x.strip()] for r in dedup_lines(df, within=False).collect()} == want
    assert {r.doc_id: [x.strip() for x in r.text.split("\n") if x.strip()] for r in dedup_lines(df).collect()} == want


def test_line_dedup_odd_rows(odd_documents):
    out = dedup_lines(odd_documents)
    assert sorted(out.columns) == sorted(odd_documents.columns)
    rows = out.orderBy("doc_id").collect()
    assert len(rows) == 9
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[2][0].text is None and by_id[3][0].text == "" and [r.digest for r in rows] == ["x"] * 9
    assert len(by_id[6]) == 2 and dedup_lines(odd_documents.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("line", ["The Old Mill By The River Stood Empty For Many Years And Nobody Ever Asked Why The Doors Were Always Open At Night", "Der Hund und die Katze sahen im Garten den Mond und die Sterne, und das Haus der Familie stand am Ende der Straße."])
def test_a_capitalised_line_stays_once(spark, make_text, line):
    rng = random.Random(21)
    second = make_text(rng, 9).title()
    texts = {i: "\n".join([make_text(rng, 12), line, make_text(rng, 11)]) for i in range(6)}
    texts |= {10 + i: "\n".join([make_text(rng, 12), line, second, make_text(rng, 11)]) for i in range(6)}
    for within in (True, False):
        got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), within=within).collect()}
        assert [i for i in got if line in got[i].text] == [0] and [i for i in got if second in got[i].text] == [10]
        for i in set(got) - {0, 10}:
            assert len(got[i].text.split()) == 23 and len(got[i].removed) == 1


def test_mirrored_sequences_are_no_repeats(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts = [j.join((a, b)[x ^ y] for x in bits) for j, a, b in (("", "a", "b"), (" ", "ab", "cd")) for y in (0, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for within in (True, False):
        got = {r.doc_id: r.text for r in dedup_lines(df, within=within).collect()}
        if not within:
            assert got == dict(enumerate(texts))
        # all that goes stands in a text before, or before in its own
        assert got[0] and got[2]


def test_hot_digests_take_the_other_way_with_the_same_result(spark, make_text, monkeypatch):
    rng = random.Random(31)
    hot, warm = make_text(rng, 12).capitalize() + ".", make_text(rng, 15).capitalize() + "."
    texts = {i: "\n".join([make_text(rng, 10), hot, hot, *([warm] if i % 7 == 0 else [])]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted((r.doc_id, r.text) for r in dedup_lines(df).collect())
    assert sum(hot in t for _, t in want) == sum(warm in t for _, t in want) == 1
    monkeypatch.setattr(common, "LEAST_HOT", 10)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    assert sorted((r.doc_id, r.text) for r in dedup_lines(df).collect()) == want


def test_whole_lines_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(WHOLE_LINES_SQL).df()
    assert sorted(map(tuple, dedup_whole_lines(spark, sf).select(*want.columns).collect())) == sorted(map(tuple, want.itertuples(index=False)))


def test_a_run_goes_only_if_it_stood_as_a_run(spark):
    """Ninety documents hold every pair of ten short sentences; one holds the ten in an order of its own."""
    said = ["Yes, sir.", "No, madam.", "Thank you.", "Come in.", "Sit down.", "Well done.", "Good night.", "Never mind.", "Not yet.", "Very well."]
    pairs = [f"{a} {b}" for a in said for b in said if a != b]
    whole = f"The first of the two that frame it stands here alone. {' '.join(said)} The second of them has other words and ends what there is."
    df = spark.createDataFrame(list(enumerate([*pairs, whole, whole])), "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert all(got[i].text == t for i, t in enumerate([*pairs, whole])) and got[91].text == ""


@pytest.mark.parametrize("seed", range(3))
def test_what_goes_stood_before_in_stretches(spark, seed):
    """Each word removed is one of eight or more side by side that stand earlier: in a smaller document, or before in this one."""
    rng = random.Random(seed)
    said = [" ".join(rng.choice(["so", "it", "was", "he", "went", "on", "then"]) for _ in range(rng.randrange(1, 5))).capitalize() + "." for _ in range(12)]
    texts = [" ".join(rng.choice(said) for _ in range(rng.randrange(3, 40))) for _ in range(60)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen, removed = set(), 0
    for i, text in enumerate(texts):
        words = text.lower().split()
        starts = [0]
        for w in text.split(" ")[:-1]:
            starts.append(starts[-1] + len(w) + 1)
        gone = [any(s.start <= a < s.end for s in got[i].removed) for a in starts]
        removed += sum(gone)
        eights = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        known = [False] * len(words)
        for j, e in enumerate(eights):
            if e in seen or e in eights[: max(0, j - 7)]:
                known[j : j + 8] = [True] * 8
        assert not [w for w, g, k in zip(words, gone, known) if g and not k]
        seen.update(eights)
    assert removed > 100


def test_a_text_that_repeats_itself_keeps_the_first(spark):
    texts = {0: "No. " * 20, 1: "Yes. " * 7}
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[0].split() == ["No."] * 8 and got[1] == texts[1]
