"""The registered op4, op6, op7 and op8 over whole tables, against plain versions."""

import hashlib
import os
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_llm_pairs import plain_pack
from test_llm_texts import PLAIN

from sparkloom.llm import common, linear, quality, queries, sanitise, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


def test_base_spans_of_all_documents(spark, docs):
    got = {r.doc_id: r for r in queries.op6_sanitisation(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d, text, _ in docs:
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if valid(m.group())] for k, (pattern, valid) in PLAIN.items()}
        r, flat = got[d], [s for k in PLAIN for s in spans[k]]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest()
        shown = r.spans.split(",") if r.spans else []
        assert shown[: len(flat)] == flat and all(s.startswith("term:") for s in shown[len(flat) :])


@pytest.mark.parametrize("n", [3_000, 24_000])
def test_spans_of_long_texts(spark, n):
    text = "".join(f"é word{k} a{k}@b.org 10.0.0.{k % 256} +1 (375) 555-{k:06d}\n" for k in range(n // 3))
    df = spark.createDataFrame([(1, text), (2, "x a@b.org y"), (3, None), (4, "no")], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in sanitise.sanitise(df).collect()}
    assert time.time() - began < 60
    mails, ips = list(re.finditer(PLAIN["email"][0], text)), list(re.finditer(PLAIN["ip"][0], text))
    assert [(s.start, s.end) for s in rows[1].email] == [m.span() for m in mails] and [(s.start, s.end) for s in rows[1].ip] == [m.span() for m in ips]
    want, at = [], 0
    for start, end, mark in sorted((s.start, s.end, f"[{k.upper()}]") for k in sanitise.KINDS for s in rows[1][k]):
        if start >= at:
            want += [text[at:start], mark]
            at = end
    assert rows[1].sanitised == "".join(want) + text[at:] and rows[2].sanitised == "x [EMAIL] y" and rows[3].sanitised is rows[4].sanitised is None


def test_bins_of_all_documents(spark, docs):
    exact, got = token_counts.counter(P.path("byte_bpe_50k.json")), {}
    for r in queries.op7_best_fit_packing(spark, DATA).collect():
        if r.bin_id is not None and r.n_tokens < 2048:
            got[r.doc_id] = r.bin_id
    plain = {d: " ".join((t or "").lower().split()).replace(" ", "") for d, t, _ in docs}
    times = Counter(plain.values())
    xx = {r.doc_id: r.c for r in spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", r"xxhash64(regexp_replace(lower(coalesce(text, '')), '[ \\t-\\r]+', '')) AS c").collect()}
    rows = [(d, s, exact(t or "") % 2048, plain[d]) for d, t, s in docs]
    order = sorted((r for r in rows if r[2]), key=lambda r: (-r[2], True, r[0], xx[r[0]], str(r[1])))
    want = plain_pack([(r[0], (r[2], r[1], r[3] if times[r[3]] > 1 else None)) for r in order], 2048)
    # the same documents share bins, whatever the bins are called
    groups = lambda bins: Counter(tuple(sorted(d for d in bins if bins[d] == b)) for b in set(bins.values()))
    assert groups(got) == groups(want)


@pytest.mark.parametrize("name", ["op4_toxicity", "op8_quality"])
def test_scores_of_all_documents(spark, docs, name):
    """Each text by itself, feature by feature, with the weights that the operator learns."""
    table, labels = common.table(spark, DATA, "documents").select("doc_id", "text"), common.table(spark, DATA, "labels")
    if name == "op4_toxicity":
        w = toxicity.fit(table, labels)
        features, score, least = toxicity.word_features, lambda s: 1 / (1 + np.exp(-np.clip(s + w[-1], -40, 40))), 0.5
        weights = w[:-1]
    else:
        weights, bias, a, b = quality.fit(table, labels)
        features, score, least = quality.shape_features, lambda s: 1 / (1 + np.exp(-np.clip(a * (s + bias) + b, -40, 40))), 0.3
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, DATA).collect()}
    assert len(got) == len(docs)
    for d, text, _ in docs:
        own = set(features(pa.array([text or ""]))[1].tolist())
        want = float(score(sum(float(weights[f]) for f in own)))
        assert abs(got[d].score - want) < 1e-9 and got[d].predicted == int(got[d].score >= least)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
    assert linear.SLICE > 0


def test_odd_rows_long_texts_and_clashing_names(spark):
    """Very long texts, repeated rows, nulls and columns named like the operators' own."""
    from pyspark.sql import functions as F

    from sparkloom.llm import chat_format, near_dups, packing

    long = " ".join(f"w{k}" for k in range(60_000))
    clash = lambda df, *names: df.withColumns({n: F.lit("clash") for n in names})
    docs = spark.createDataFrame([(1, long, "s"), (2, long + " x", "s"), (2, long + " x", "s"), (3, None, "t"), (None, long, None), (4, "a@b.org", "t")], "doc_id long, text string, source string")
    found = near_dups.near_duplicates(clash(docs, "sig", "node", "component_id", "n")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in found) == [(False, 1, 1), (False, 2, 1), (False, 2, 1), (False, 3, 3), (False, 4, 4), (True, None, None)]
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0
    spans = {r.doc_id: r for r in sanitise.sanitise(clash(docs, "email", "terms", "digest", "pattern", "has")).where("doc_id <> 2").collect()}
    assert len(spans[4].email) == 1 and spans[4].sanitised == "[EMAIL]" and spans[1].terms == [] and sanitise.sanitise(docs.limit(0)).count() == 0
    bins = packing.pack(packing.packable(clash(docs, "n_tokens", "cluster", "shard", "bin_id"))).collect()
    assert sum(r.n_tokens for r in bins) == 60_000 + 2 * 60_001 + 60_000 + 1 and sum(r.bin_id is None for r in bins) == 1
    assert packing.pack(packing.packable(docs.limit(0))).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "<|end|>"), (1, 1, "assistant", long + "<|end|>"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    chats = {r.conv_id: r for r in chat_format.format_chats(clash(turns, "formatted", "segments", "state", "valid")).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    assert [t.text for t in chats[1].back] == [long, long + "<|end|>", long + "<|end|>"] and not chats[1].valid and [t.text for t in chats[2].back] == [""]
    assert chat_format.format_chats(turns.limit(0)).count() == 0
