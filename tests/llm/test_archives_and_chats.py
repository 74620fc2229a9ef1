import base64
import hashlib

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.chat_format import CONTROLS, OP10_SQL, assemble, format_conversations, op10_chat_format, parse, read_back
from tessera.llm.common import shared_dir
from tessera.llm.warc import OP9_SQL, op9_warc, read_archives, write_archives


def run_sql(sf, table, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return {tuple(r) for r in con.execute(sql).fetchall()}


def test_warc_against_sql(spark, sf):
    df = op9_warc(spark, sf)
    got = {tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    assert got == run_sql(sf, "pages", OP9_SQL)


def test_warc_odd_rows(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (2, "http://b", "same"), (3, None, None), (4, "u\r\nX: y", ""), (None, "http://n", "only"), (None, "http://m", "same"), (5, "ü", "é" * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS sha1", "1 AS winner")
    manifest = write_archives(pages, shared_dir(spark, "warc-test"), target=1000, sample=300).cache()
    assert manifest.count() >= 1 and manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read_archives(manifest).collect()), key=str)
    assert got == sorted(
        [(1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 4, "response", None), (None, 4, "revisit", 2), (5, 200000, "response", None)],
        key=str,
    )
    for r in read_archives(manifest).where("page_id = 5").collect():
        assert r.payload_digest == base64.b32encode(hashlib.sha1(("é" * 100000).encode()).digest()).decode()
    manifest.unpersist()


def test_archive_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(none, shared_dir(spark, "warc-none"))).count() == 0


def test_chats_against_sql(spark, sf):
    df = op10_chat_format(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(OP10_SQL).df()
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(map(tuple, want.itertuples(index=False)))


pieces = st.lists(st.sampled_from([*(c.decode() for c in CONTROLS), "\\", "<", "|", ">", "[", "/", "x", "\n", "é", "😀", "</", "s>"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["user", "assistant", "a\nb", "x\\"]), pieces), min_size=1, max_size=6))
def test_any_text_comes_back(turns):
    turns.sort(key=lambda t: t[0])
    batch = assemble(pa.array([t[0] for t in turns], pa.int64()), pa.array([t[1] for t in turns]), pa.array([t[2] for t in turns]))
    for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
        own = [(r.encode(), t.encode()) for c, r, t in turns if c == conv]
        raw = text.encode()
        assert parse(raw) == own
        assert len(starts) == sum(r == b"assistant" for r, _ in own)


def test_chats_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (2, None, "assistant", "late"), (None, 0, "user", "lost"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (3, 0, "assistant", "w " * 200000)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS n_turns")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in read_back(format_conversations(chats)).collect()}
    assert got == {1: (4, 6), 2: (1, 4), None: (1, 0), 3: (1, 400000)}
    assert read_back(format_conversations(chats.limit(0))).count() == 0
