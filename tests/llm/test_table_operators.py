"""Brute-force versions and edge cases of formatting, filtering, mixing, scoring and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import classifier as C
from quillmesh.llm.chat import format_chats, read_chats
from quillmesh.llm.mixture import Mixture
from quillmesh.llm.url_filter import RULES, TemplateTree, filter_urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, formatted int"


def test_chats_round_trip(spark):
    hard = ["", "<|turn|>", "<\\|text|>", "a<|more|>b", "<|end|>\n", "<\\\\|", "<", "|", "<|", "é<|😀|>", "</s>[INST] ok [/INST]", "\\", "$1 \\1"]
    rows, n = [], 0
    rng = random.Random(5)
    for conv in range(30):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "<|x", None]), rng.choice([*hard, None]), 1))
    rows += [(100, None, "user", "first", 1), (100, 0, "assistant", "b", 1), (100, 0, "assistant", "a", 1), (100, 0, "assistant", "a", 1), (None, 0, "assistant", "x", 1)]
    formatted = format_chats(spark.createDataFrame(rows, TURNS))
    back = {r.conv_id: r for r in read_chats(formatted).collect()}
    spans = {r.conv_id: r.loss_spans for r in formatted.collect()}
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(back) == set(want)
    for conv, turns in want.items():
        r = back[conv]
        if conv == 100:
            turns = sorted(turns)
        got = [(t.role, t.text) for t in r.turns]
        assert got == [t[1:] for t in sorted(turns, key=lambda t: t[0])]
        assert "".join(r.loss_texts) == "".join(x for role, x in got if role == "assistant")
        # the mask holds texts and nothing between them
        under = [r.formatted[s.start : s.end] for s in spans[conv]]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in under] == [x for role, x in got if role == "assistant"]
        assert not any("<|" in x for x in under)
        merged = sum(1 for i, t in enumerate(got) if i == 0 or t[0] != got[i - 1][0])
        assert r.formatted.count("<|turn|>") == merged
    assert format_chats(spark.createDataFrame([], TURNS)).count() == 0


def judged(u):
    if u is None or "://" not in u:
        host = path = ""
    else:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for t, v in RULES:
        name, rest = t.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((t, v))
    return host, path, max(fits, key=lambda f: len(f[0]), default=None)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Org", "http://A.Org/", "https://x.example.org/en/1234?q#f", "https://x.example.org/en/2#f", "://example.org/es/", "http://é.com/fr/", "ftp://com/de/x?y", "http://notorg/x", "a://b://c/d", "http://x.com/" + "a/" * 3000, "http://x.com/" + "z" * 100_000, "http://h?a://b/c", "http://x.com/de\n/x"]
    rows = [(i, u, "h", 1) for i, u in enumerate(urls * 2)]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict int")).collect()}
    assert len(got) == len(rows)
    for i, u, _, _ in rows:
        host, path, rule = judged(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]), u
        assert rule is None or r.verdict == rule[1]
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_learn_bad_branches(spark):
    rows = []
    for k in range(60):
        rows += [("h", f"/good/{k}", False), ("h", f"/bad/{k}.html", True), ("h", f"/bad/2020-01-{k}", None), ("h", f"/good/x/{k}/y", None), ("other", f"/p{k}x", None)]
    tree = TemplateTree(spark.createDataFrame(rows, "host string, path string, blocked boolean"), fanout=5)
    out = tree.judge(spark.createDataFrame(rows, "host string, path string, blocked boolean")).collect()
    assert all(r.rejected for r in out if r.path.startswith("/bad/") and r.path.endswith(".html"))
    assert not any(r.rejected for r in out if r.path.startswith("/good/"))
    assert {r.template for r in out if r.path.startswith("/bad/") and r.path.endswith(".html")} == {"h/bad/*.html"}
    assert len({r.template for r in out if r.host == "other"}) == 1  # a crowd of branches without labels


def test_templates_tell_deep_branches_apart(spark):
    rows = [("h", f"/a/b/c/{kind}/{k}", kind == "bad") for k in range(40) for kind in ("good", "bad")]
    table = spark.createDataFrame(rows, "host string, path string, blocked boolean")
    out = TemplateTree(table).judge(table).collect()
    assert len(out) == 80 and all(r.rejected == r.blocked for r in out)
    assert {r.template for r in out} == {"h/a/b/c/good/*", "h/a/b/c/bad/*"}


def fill(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] > cap * sizes[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("slots", [1 << 20, 200])
def test_mixture(spark, slots):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)) if i % 17 else None, rng.choice(["a", "a", "a", "B", "é", None, "c"]), 9) for i in range(400)]
    rows += [(400, "many " * 5000, "hot", 9), (401, "", "void", 9), (1, "x y z", "a", 9), (1, "x y z", "a", 9), (None, "p q", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    first = sorted([tuple(r) for r in Mixture(docs, slots=slots).documents.collect()], key=repr)
    assert first == sorted([tuple(r) for r in Mixture(docs.repartition(7), slots=slots).documents.collect()], key=repr)
    assert len(first) == len(rows)
    sizes, taken, target = {}, {}, {}
    for _, source, size, total, goal, got, _ in first:
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + got
        target[source] = goal
        assert 0 <= got <= 2 * size
    want = fill(sizes)
    block = -(-sum(want.values()) // slots)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 4 * block + 2, s
    assert Mixture(spark.createDataFrame([], "doc_id long, text string, source string")).documents.count() == 0


def test_mixture_meets_small_targets(spark):
    rows = [(i, "w " * 500, "hot") for i in range(400)] + [(1000 + 10 * k + i, "v " * (10 * k + 7), f"small{k}") for k in range(12) for i in range(3)]
    got = Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=64).documents.collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    off = {s: abs(taken[s] - t) / t for s, t in target.items() if s != "hot"}
    assert len(off) == 12 and max(off.values()) <= 0.25, off  # a few words of 42


def test_classifier_learns_and_handles_odd_rows(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "bridge", "under", "water"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["WIN!!", "$$$", "FREE!!", "click###"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), 0.1) for i in range(300)] + [(1000, None, 0.1), (1001, "", 0.1), (None, "river", 0.1), (5, "river river", 0.1), (1002, "x" * 300_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = [(i, 1 if i % 3 else 0) for i in range(300)] + [(7, 0), (8, None), (None, 1), (9999, 1)]
    got = {(r.doc_id, r.text): r for r in C.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows[:300]:
        r = got[(i, t)]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r.predicted == (1 if i % 3 else 0) and 0 <= r.score <= 1
    assert got[(1000, None)].score == got[(1001, "")].score and not got[(None, "river")].held_out
    none = C.score_documents(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}
    assert C.score_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    from quillmesh.llm.classifier import op1_query

    got = op1_query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.9


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from test_text_operators import brute_hits, components

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    columns = docs.columns
    kept = P.keep_quality(spark, docs, src)
    assert kept.columns == columns
    scores = C.score_documents(docs, spark.read.parquet(f"{src}/labels.parquet").select("doc_id", "quality"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores.filter("score >= 0.3").collect()}
    one = P.keep_one_of_near_copies(spark, docs, src)
    rows = docs.orderBy("doc_id").collect()
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted({rows[c].doc_id for _, _, c in components([r.text for r in rows])})
    clean = P.drop_contaminated(spark, docs, src)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    bad = {rows[h[0]].doc_id for h in brute_hits([r.text for r in rows], items) if h[4]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - bad
    mixed = P.mix_sources(spark, docs, src).collect()
    taken = {r.doc_id: r for r in Mixture(docs).documents.collect()}
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(abs(times.get(d, 0) - r.taken / r["size"]) < 1 and times.get(d, 0) <= 2 for d, r in taken.items() if r["size"])
    assert P.run(spark, src).filter(F.col("n_tokens") < 1).count() == 0


def test_mixture_does_not_broadcast_pieces(spark):
    docs = spark.createDataFrame([(i, "w " * 500, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    mixed = Mixture(docs).documents
    assert abs(mixed.agg(F.sum("taken")).first()[0] - 30_000) < 30
    # 20,000 pieces of 40 rows, which look small by their bytes
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[rank#\d+L?, at#\d+L?\]", plan) and not re.search(r"BroadcastHashJoin \[rank#\d+L?, at#", plan)


def test_pipeline_keeps_one_row_of_near_copies(spark):
    import corpus_pipeline as P

    long, other = " ".join(f"k{i}" for i in range(60)), " ".join(f"m{i}" for i in range(60))
    rows = [(5, long, 1, 2, 3), (9, other, 1, 2, 3), (9, long, 1, 2, 3), (9, long, 1, 2, 3), (7, other + " x", 1, 2, 3), (8, "", 1, 2, 3), (8, None, 1, 2, 3), (None, long, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key int, _h int, node int")
    got = P.keep_one_of_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(5, long), (7, other + " x"), (8, ""), (8, ""), (0, long)])


def test_pipeline_mix_meets_targets(spark):
    import corpus_pipeline as P

    rows = [(i % 2900, f"w{i} " * (20 + i % 50), "ab"[i % 7 > 4], i, i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_times int, _k int")
    out = P.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    want = {r.source: r.target for r in Mixture(docs).documents.select("source", "target").distinct().collect()}
    assert all(abs(words[s] - want[s]) <= 0.03 * want[s] for s in want), (words, want)
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in P.mix_sources(spark, docs.repartition(5), "").collect())


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as P

    kind = "doc_id long, text string, lang string, source string, n_chars long, size int"
    rows = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (None, "no id here at all today", "en", "a", 5, 1), (3, "some words " * 30, "en", "a", 9, 1), (3, "some words " * 30, "en", "a", 9, 1), (4, "other text " * 40, "en", "b", 9, 1)]
    for name, table in (("full", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(table, kind).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "unrelated item")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = P.run(spark, d).collect()
        assert {r.doc_id for r in out} == ({None, 3, 4} if table else set())
