"""Divergence of sources against a plain count."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.llm import divergence as module
from tessera.llm.divergence import OP12_SQL, audit, divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    occurrences, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        occurrences[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = set()
    for lang in documents:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        groups = {s: c for (g, s), c in occurrences.items() if g == lang}
        whole = sum(groups.values(), Counter())
        total = lambda c: sum(c[t] for t in kept) + 5 * len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // total(c) for t in kept}
        shares, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s, p in shares.items():
            pairs = [(-sum(abs(p[t] - r[t]) for t in kept), o.encode()) for o, r in shares.items() if o != s]
            above = [(q[t] - p[t], t.encode()) for t in kept if groups[s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(seed=3, n=400):
    rng = random.Random(seed)
    words = [f"wort{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}" for k in range(40)] + ["Éa", "日本", "\U0001f600x", "K", "it's"]
    rows = [(" ".join(rng.choices(words, [1 + (k + j) % 7 for k in range(len(words))], k=rng.randrange(0, 30))), rng.choice("ab"), f"s{j}") for j in (rng.randrange(4) for _ in range(n))]
    rows += [(None, "a", "s0"), ("", None, "s1"), ("worta\x00WORTA wortB", "a", None), (None, "c", "s0"), (None, "c", "s1"), (None, "d", None)]
    return rows + rows[:50] + [("x y " * 20000, "b", "s9")]


def test_whole_result(spark):
    rows = table()
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "'v' AS value", "3 AS p", "null AS doc_id")
    assert rows_of(divergence(df)) == brute(rows)


@pytest.mark.parametrize("least, top", [(1, 3), (10**9, 50)])
def test_other_bounds(spark, least, top):
    rows = table(5, 120)
    assert rows_of(audit(spark.createDataFrame(rows, "text string, lang string, source string"), least, top)) == brute(rows, least, top)


def test_many_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(module, "MOST_BROADCAST", 0)
    rows = table(7, 150)
    assert rows_of(audit(spark.createDataFrame(rows, "text string, lang string, source string"), 3)) == brute(rows, 3)


def test_empty(spark):
    assert divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({OP12_SQL})").fetchall()
    assert rows_of(divergence(spark.read.parquet(f"{sf}/documents.parquet"))) == set(want)
