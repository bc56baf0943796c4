"""The registered queries over whole tables: against their SQL, or against plain versions of what they do."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

from sparkloom.llm import queries, token_counts

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(columns).collect())
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(row[names.index(c)] for c in columns) for row in found.fetchall())


def test_token_counts(spark, con):
    exact = token_counts.counter(P.path("byte_bpe_50k.json"))
    want = {d: (len((t or "").encode()), exact(t or ""), exact(t or "") > 512) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, DATA).collect()} == want


def test_packed_bins_hold_all_tokens_and_no_conflict(spark, con):
    exact = token_counts.counter(P.path("byte_bpe_50k.json"))
    docs = {d: (s, exact(t or ""), "".join((t or "").lower().split())) for d, s, t in con.execute("SELECT doc_id, source, text FROM documents").fetchall()}
    bins, total = defaultdict(list), Counter()
    for r in queries.op7_best_fit_packing(spark, DATA).collect():
        total[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert total == {d: n for d, (_, n, _) in docs.items()}
    for rows in bins.values():
        rows = sorted(rows, key=lambda r: r.start)
        ends = [r.start + r.n_tokens for r in rows]
        assert rows[0].start == 0 and [r.start for r in rows[1:]] == ends[:-1] and ends[-1] <= 2048
        assert len({docs[r.doc_id][0] for r in rows}) == len(rows) == len({docs[r.doc_id][2] for r in rows})


@pytest.mark.parametrize("name", ["op4_toxicity", "op8_quality"])
def test_scores(spark, con, name):
    rows = queries.QUERIES[name](spark, DATA).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0] and all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if name == "op4_toxicity" else 0.3)) for r in rows)


def test_base_spans_are_counted(spark):
    for r in queries.op6_sanitisation(spark, DATA).collect():
        kinds = Counter(x.split(":")[0] for x in r.spans.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
