"""Linkage, evaluation, profiling, serialisation, sources and streams on small tables."""

import json
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import augment, cleaning, consolidate, evaluate, linkage, numbering, profile, retrieval, serialize, training
from quillmesh.operators.components import connected_components
from quillmesh.operators.labelling import Labelling
from quillmesh.operators.registry import default_registry
from quillmesh.sources import sheets, tables
from quillmesh.streaming import link_stream

REC = "record_id long, source string, exp long, name string, key string"


def recs(spark):
    rows = [
        (0, "A", 1, "x", "ANA LUZ"), (1, "A", 1, "x", "ANA LUZ"), (2, "B", 1, "x", "ANA LUZ"), (3, "C", 1, "x", "ANA LUX"), (4, "A", None, "x", "SOLO"), (5, "B", 9, "x", "SOLO"),
        (6, "C", 9, "x", "SOLO"), (7, "B", 9, "x", "SOLO"), (8, "A", None, "x", ""), (9, "B", 5, "x", ""), (10, "C", 5, "x", ""), (11, "C", None, "x", "QQ"),
    ]
    return spark.createDataFrame(rows, REC)


def test_candidates_and_cascade(spark):
    pairs = linkage.candidate_pairs(recs(spark), "A")
    got = {(r.id_a, r.id_b): r.criterion for r in linkage.classify(linkage.scored_pairs(pairs)).collect()}
    assert got[(0, 2)] == linkage.EXACT and got[(0, 3)] == linkage.METRIC and got[(9, 10)] == linkage.EXACT
    assert got[(4, 5)] == linkage.OPEN and got[(4, 6)] == linkage.OPEN and (4, 7) not in got and (1, 2) not in got
    assert not any(8 in k or 11 in k for k in got)


def test_thresholds_are_inclusive(spark):
    rows = spark.createDataFrame([(1, 2, "A", "B", "a", "b", 1, False, 0.88, 0.0), (3, 4, "A", "B", "a", "b", 1, False, 0.0, 0.85), (5, 6, "A", "B", "a", "b", 1, False, 0.879, 0.849)], "id_a int, id_b int, source_a string, source_b string, key_a string, key_b string, exp_shared long, null_exp boolean, jw double, lev double")
    assert [r.criterion for r in linkage.classify(rows).orderBy("id_a").collect()] == [linkage.METRIC, linkage.METRIC, linkage.OPEN]


def test_review(spark):
    kind = "id_a int, id_b int, criterion string, decision string"
    rows = spark.createDataFrame([(1, 1, linkage.OPEN, None), (2, 2, linkage.OPEN, "match"), (3, 3, linkage.EXACT, "no_match"), (4, 4, linkage.METRIC, " ")], kind)
    cols = rows.select("id_a", linkage.review_state(F.col("criterion"), F.col("decision")).alias("s"), linkage.is_positive(F.col("criterion"), F.col("decision")).alias("p")).orderBy("id_a").collect()
    assert [(r.s, r.p) for r in cols] == [("yellow", False), ("green", True), ("red", False), ("green", True)]
    assert [(r.criterion, r.decision) for r in linkage.settle(rows).orderBy("id_a").collect()] == [(linkage.OPEN, None), (linkage.REVIEWED, "match"), (linkage.EXACT, "no_match"), (linkage.METRIC, "match")]
    old = spark.createDataFrame([(1, 1, "x", "match"), (2, 2, "x", "")], kind)
    assert [r.decision for r in linkage.merge_decisions(rows, old).orderBy("id_a").collect()] == ["match", "match", "no_match", " "]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3), (7, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1100)) and len(got) == 301
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_entities_numbering_and_split(spark):
    r = recs(spark)
    edges = spark.createDataFrame([(0, 2), (2, 3), (5, 6)], "src long, dst long").union(linkage.star_edges(r))
    ent = r.join(linkage.entities(r, edges), "record_id")
    ids = {x.record_id: x.entity_id for x in ent.collect()}
    assert ids[0] == ids[1] == ids[2] == ids[3] == 0 and ids[5] == ids[6] == ids[7] and sorted(set(ids.values())) == list(range(len(set(ids.values()))))
    split = linkage.split_entities(ent).collect()
    assert len(split) == 12 and all(len({s.split for s in split if s.entity_id == e}) == 1 for e in set(ids.values()))
    assert linkage.split_statistics(linkage.split_entities(ent)).agg(F.sum("n_records")).first()[0] == 12
    with pytest.raises(ValueError):
        linkage.split_entities(ent, 0.9, 0.2)
    nulls = {x.record_id: x.entity_id for x in linkage.first_seen_ids(r, ["exp", "key"]).collect()}
    assert nulls[0] == nulls[1] == 0 and nulls[4] != nulls[5]
    docs = consolidate.entity_documents(ent.drop("root"), default_registry())
    assert docs.filter("entity_id = 0").first().cluster_size == 4
    assert consolidate.document_statistics(docs).first().n_entities == len(set(ids.values()))
    assert '"exp":null' in "".join(x.document for x in consolidate.as_json(docs).collect())
    with pytest.raises(ValueError):
        default_registry().comparator("levenshtein", "key")


def test_binary_metrics_edge_cases(spark):
    kind = "score double, label int"
    one_class = spark.createDataFrame([(0.2, 1), (0.9, 1)], kind)
    assert evaluate.roc_auc(one_class).first().roc_auc is None
    none = evaluate.binary_metrics(spark.createDataFrame([(0.2, 0)], kind)).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0, 0, 0, 1)
    ties = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1)], kind)
    assert evaluate.roc_auc(ties).first().roc_auc == 0.5 and evaluate.average_precision(ties).first().average_precision == pytest.approx(2 / 3, abs=1e-6)
    assert evaluate.best_threshold(ties).first().threshold == 0.0
    edges = spark.createDataFrame([(0.6, 1), (0.7, 1), (0.61, 1), (1.0, 1)], kind)
    assert {r.bin: r.n for r in evaluate.reliability(edges).collect()} == {5: 1, 6: 2, 9: 1}


def test_temperature_recovers_scale(spark):
    rows = spark.range(4000).select((F.rand(1) * 8 - 4).alias("z"), F.rand(2).alias("u")).withColumn("label", (F.col("u") < 1 / (1 + F.exp(-F.col("z")))).cast("int"))
    rows = rows.select((F.col("z") * 3).alias("logit"), "label").cache()
    assert evaluate.fit_temperature(rows) == pytest.approx(3.0, rel=0.15)
    assert evaluate.fit_temperature(rows.limit(0)) == 1.0


def test_retrieval(spark):
    rows = [(i, [1.0 if j == i % 3 else 0.0 for j in range(3)] + [i / 100], i % 3, i % 2) for i in range(9)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, entity int, source int")
    full = {(r.query_id, r["rank"]): r.cand_id for r in retrieval.top_k(v, v, 20).collect()}
    assert len(full) == 72 and full[(0, 1)] == 3
    assert full == {(r.query_id, r["rank"]): r.cand_id for r in retrieval.top_k(v, v, 20, block_rows=2).collect()}
    m = {r.k: r for r in retrieval.metrics_at_k(retrieval.top_k(v, v, 5), v, v, (1, 5)).collect()}
    assert m[1].hit == 1.0 and m[5].recall == 1.0 and m[5].precision == 0.4
    kinds = {r.type for r in retrieval.mine_hard_pairs(retrieval.top_k(v, v, 3), v).collect()}
    assert kinds <= {"positive", "hard_positive", "hard_negative"} and "positive" in kinds
    few = retrieval.mine_hard_pairs(retrieval.top_k(v, v, 3), v, max_easy=1)
    assert few.filter("type = 'positive'").count() == 1 and "similarity" in few.columns


def test_hard_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIR_ROWS", 100)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 100)
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = np.random.default_rng(3)
    e = rng.normal(size=(900, 16)).astype(np.float32)
    e[100:140] = e[99]  # more ties than k
    entity, source = [None if i % 97 == 0 else min(i % 7, 3) if i else 9 for i in range(900)], [i % 3 for i in range(900)]
    v = spark.createDataFrame([(i, e[i].tolist(), entity[i], source[i]) for i in range(900)], "id long, embedding array<float>, entity int, source int").repartition(4)
    sims = np.round(e.astype(float) @ e.T.astype(float), 9)
    ranked = {(i, j) for i in range(900) for j in sorted((x for x in range(900) if x != i), key=lambda x: (-sims[i, x], x))[:5]}
    near = {(min(p), max(p)) for p in ranked}
    want = {}
    for a in range(900):
        for b in range(a + 1, 900):
            if source[a] != source[b] and None not in (entity[a], entity[b]) and (entity[a] == entity[b] or (a, b) in near):
                want[a, b] = "hard_negative" if entity[a] != entity[b] else "positive" if (a, b) in near else "hard_positive"
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    for exact in (True, False):
        top = retrieval.top_k(v, v, 5, block_rows=200, exact=exact).cache()
        assert {(r.query_id, r.cand_id) for r in top.collect()} == ranked
        before = written()
        got = retrieval.mine_hard_pairs(top, v).collect()
        assert len(got) == len(want) and {(r.id_a, r.id_b): r.type for r in got} == want
        assert all(abs(r.similarity - sims[r.id_a, r.id_b]) < 1e-6 and r.label == (r.type != "hard_negative") for r in got)
        assert not exact or written() - before < 12 * len(want)  # no vector moves with a pair
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)


def test_serialise_round_trip_and_augment(spark):
    df = spark.createDataFrame([(1, "ana luz", None, 2.50), (2, None, None, None)], "id long, nombre string, x string, pago double")
    blocks = [("ID", ["id", "nombre"]), ("C", ["x", "pago"]), ("NONE", ["absent"])]
    text = df.select("id", serialize.serialize(df, blocks, True, False).alias("t"))
    rows = {r.id: r.t for r in text.collect()}
    assert rows[1] == "[BLK_ID] [COL] id [VAL] 1 [COL] nombre [VAL] ana luz [BLK_C] [COL] x [VAL] NULL [COL] pago [VAL] 2.5"
    assert rows[2] == "[BLK_ID] [COL] id [VAL] 2 [COL] nombre [VAL] NULL"
    parsed = text.select(serialize.parse(F.col("t")).alias("p")).collect()[0].p
    assert [(p.block, p.col, p.val) for p in parsed][:2] == [("ID", "id", "1"), ("ID", "nombre", "ana luz")]
    k = F.col("id")
    same = text.select("t", augment.augment(F.col("t"), k, 3, span=0.5).alias("a"), augment.augment(F.col("t"), k, 3, span=0.5).alias("b")).collect()
    assert all(r.a == r.b for r in same)
    moved = text.select("t", augment.shuffle_columns(augment.shuffle_blocks(F.col("t"), k, 1), k, 1).alias("a")).collect()
    assert all(sorted(r.a.split(" ")) == sorted(r.t.split(" ")) for r in moved)
    masked = text.select(augment.mask_attributes(F.col("t"), k, 1, 1.0, ("nombre",)).alias("a")).collect()[0].a
    assert "[COL] nombre [VAL] ana luz" in masked and "[COL] id [VAL] NULL" in masked
    assert text.select(augment.inject_typos(F.col("t"), k, 1, 0.0).alias("a"), "t").filter("a <> t").count() == 0


def test_typos_and_masks_touch_values_only(spark):
    blocks = [("ID", ["nombre", "edad"]), ("C", ["nota", "none"])]
    df = spark.createDataFrame([(i, f"maria del mar {i % 7}", i, "una nota larga aqui", None) for i in range(400)], "id long, nombre string, edad long, nota string, none string")
    text = df.select("id", serialize.serialize(df, blocks, True, False).alias("t"))
    k = F.col("id")
    for p in (0.3, 1.0):
        typed = text.select("id", F.posexplode(serialize.parse(augment.inject_typos(F.col("t"), k, 5, p))).alias("i", "x")).select("id", "x.*").collect()
        assert len(typed) == 1600 and {(r.block, r.col) for r in typed} == {("ID", "nombre"), ("ID", "edad"), ("C", "nota"), ("C", "none")}
        assert {r.val for r in typed if r.col == "none"} == {"NULL"}
        words = [(a, b) for r in typed if r.col == "nota" for a, b in zip("una nota larga aqui".split(), r.val.split(), strict=True)]
        share = sum(a != b for a, b in words) / len(words)
        assert 0.75 * p < share <= p + 0.05 and all(abs(len(a) - len(b)) <= 1 for a, b in words)
        assert all(r.val == str(r.id) for r in typed if r.col == "edad" and r.id < 10)  # one letter is never mistyped
    # a chance for each value, never a protected one
    masked = text.select("id", F.explode(serialize.parse(augment.augment(F.col("t"), k, 5, 0, 0, 0.25, 0))).alias("x")).select("x.*").collect()
    gone = {c: sum(r.val == "NULL" for r in masked if r.col == c) / 400 for c in ("nombre", "edad", "nota")}
    assert gone["nombre"] == 0 and 0.15 < gone["edad"] < 0.35 and 0.15 < gone["nota"] < 0.35


def test_running_and_numbers(spark):
    rows = [(i, (i * 37) % 1000, 1 if i % 3 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "part long, v long, base_0 int").repartition(6)
    got = numbering.numbered(df, [F.col("v")], "n").collect()
    assert all(r.n == r.v for r in got) and len(got) == 1000 and got[0].asDict().keys() == {"part", "v", "base_0", "n"}
    down = numbering.running(df, [F.desc("v")], {"s": F.col("v"), "c": F.lit(1)}).collect()
    assert all((r.c, r.s) == (1000 - r.v, sum(range(r.v, 1000))) for r in down)
    assert numbering.numbered(df.limit(0), [F.col("v")], "n").count() == 0
    q = profile.cuts(df, F.col("v"), (0.0, 0.3, 1.0)).first().q
    assert [round(x, 6) for x in q] == [0.0, 299.7, 999.0]
    assert profile.cuts(df.limit(0), F.col("v"), (0.5,)).first().q in ([None], None)


def test_components_in_rounds_and_in_one_task(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 10] + [(100, 3), (7, 7)], "src long, dst long")
    one = {r.node: r.component for r in connected_components(edges).collect()}
    assert one == {r.node: r.component for r in connected_components(edges, small=0).collect()} and one[100] == 1


def test_cascade_with_python_for_undecided_pairs(spark):
    names = ["", "ANA", "ANA LUZ", "ANALUZ", "LUZ ANA", "MARTHA", "MARHTA", "DIXON", "DICKSONX", "JELLYFISH", "SMELLYFISH", "ABCD EFGH", "ABCD EFGX", "A", "B"]
    pairs = spark.createDataFrame([(a, b, n) for a in names for b in names for n in (False, True)], "key_a string, key_b string, null_exp boolean")
    of = lambda u: {(r.key_a, r.key_b, r.null_exp): r.criterion for r in linkage.classify(linkage.scored_pairs(pairs, undecided_only=u)).collect()}
    assert of(True) == of(False)


def test_review_sheets(spark, tmp_path):
    rows = [(2, 1, "unconfirmed", None, "é <&> \x01x"), (1, 2, "exact_key", "no_match", " a  b "), (3, 4, "classic_metric", " ", None)]
    df = spark.createDataFrame(rows, "id_a long, id_b long, criterion string, decision string, key_a string")
    path = f"{tmp_path}/r.xlsx"
    sheets.write_sheet(df, path)
    got = sheets.read_sheet(spark, path).orderBy("id_a").collect()
    assert [(r.id_a, r.id_b, r.decision) for r in got] == [(1, 2, "no_match"), (2, 1, None), (3, 4, None)] and got[1].key_a == "é <&> x"
    with zipfile.ZipFile(path) as z:
        text = z.read("xl/worksheets/sheet1.xml").decode()
    style = {n: k + 1 for k, n in enumerate(sheets.FILLS)}
    assert f'r="A2" s="{style["red"]}"' in text and f'r="A3" s="{style["yellow"]}"' in text and f'r="A4" s="{style["green"]}"' in text and 'r="D2" s="0"' in text
    assert 'state="frozen"' in text and "match,no_match" in text
    assert [sheets.column_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    with pytest.raises(ValueError, match="no sheet"):
        sheets.read_sheet(spark, path, "other")


def test_review_sheet_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 300)
    monkeypatch.setattr(sheets, "PIECE_ROWS", 70)
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id_a"), "id", F.lit("unconfirmed").alias("criterion"), F.when(F.col("id") % 3 == 0, "match").alias("decision"), F.lit("é <").alias("key_a")).withColumnRenamed("id", "id_b")
    path = f"{tmp_path}/r.xlsx"
    sheets.write_sheet(df, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and 'name="pairs"' in z.read("xl/workbook.xml").decode() and 'name="pairs 4"' in z.read("xl/workbook.xml").decode()
        texts = [z.read(f"xl/worksheets/sheet{k}.xml").decode() for k in (1, 2, 3, 4)]
    assert [t.count("<row ") for t in texts] == [301, 301, 301, 101] and 'sqref="D2:D301"' in texts[2] and 'sqref="D2:D101"' in texts[3]
    assert '<c r="A2" s="' in texts[1] and "<v>300</v>" in texts[1] and texts[0].index('<row r="2">') < texts[0].index('<row r="140">') < texts[0].index('<row r="301">')
    got = sheets.read_sheet(spark, path)
    want = df.select("id_a", "id_b", "criterion", "decision", "key_a")
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    sheets.write_sheet(df.limit(0), path)
    assert sheets.read_sheet(spark, path).count() == 0 and sheets.read_sheet(spark, path).columns == want.columns
    sheets.write_sheet(got, path)  # a table read from the file that it replaces
    assert sheets.read_sheet(spark, path).count() == 1000


def test_review_sheet_read_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 300)
    monkeypatch.setattr(sheets, "BLOCK_BYTES", 500, raising=False)
    df = spark.range(1000).select(F.col("id").alias("id_a"), (F.col("id") * 7).alias("id_b"), F.lit("unconfirmed").alias("criterion"), F.lit(None).cast("string").alias("decision"), F.md5(F.col("id").cast("string")).alias("key_a"))
    path, other = f"{tmp_path}/r.xlsx", f"{tmp_path}/shared.xlsx"
    sheets.write_sheet(df, path)
    inline = re.compile(r't="inlineStr"><is><t xml:space="preserve">([^<]*)</t></is>')
    texts: dict[str, int] = {}
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(other, "w") as out:  # as other programs save it: shared texts, here before the sheets, and nothing packed
        files = {n: z.read(n).decode() for n in z.namelist()}
        for n in files:
            files[n] = inline.sub(lambda m: f't="s"><v>{texts.setdefault(m[1], len(texts))}</v>', files[n]) if "worksheets" in n else files[n]
        out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets.NS}">' + "".join(f"<si><t>{x}</t></si>" for x in texts) + "</sst>")
        for n, x in files.items():
            out.writestr(n, x)
    # a whole file as one value is an error here
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10000")
    try:
        for at in (path, other):
            got = sheets.read_sheet(spark, at)
            assert got.columns == df.columns and got.exceptAll(df).count() == df.exceptAll(got).count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    data = bytearray((tmp_path / "shared.xlsx").read_bytes())
    data[data.index(b"unconfirmed") + 2] ^= 1
    (tmp_path / "damaged.xlsx").write_bytes(data)
    with pytest.raises(Exception, match="is damaged"):
        sheets.read_sheet(spark, f"{tmp_path}/damaged.xlsx")


def test_labelling_guards(spark, tmp_path):
    kind = "source string, exp long, name string, key string, text string, place long"
    tables = [spark.createDataFrame([(s, 1 if i else None, "Ana", "ANA", f"{s}{i}", i) for i in range(2)], kind) for s in "ABC"]
    work = Labelling(spark, f"{tmp_path}/w")
    with pytest.raises(FileNotFoundError):
        work.finalize()
    with pytest.raises(ValueError, match="3 are expected"):
        work.classify(tables[:2])
    with pytest.raises(PermissionError):
        Labelling(spark, f"{tmp_path}/w", canonical=True).classify(tables)
    assert work.classify(tables).count() == 5  # three pairs by number, two by name
    done = {r.text: r.entity_id for r in work.finalize().collect()}
    assert done["A1"] == done["B1"] == done["C1"] != done["A0"]
    with pytest.raises(ValueError, match="were classified"):
        work.finalize([tables[0].limit(1), *tables[1:]])
    again = work.finalize([t.withColumn("text", F.lit("new")) for t in tables])
    assert {r.text for r in again.collect()} == {"new"}
    sheet = sheets.read_sheet(spark, work.sheet_path)
    assert {"entity_id_a", "entity_id_b"} <= set(sheet.columns) and sheet.filter("criterion = 'exact_key' and decision = 'match'").count() == 3


def test_labelling_over_several_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 4)
    kind = "source string, exp long, name string, key string, text string, place long"
    tables = [spark.createDataFrame([(s, i, "Ana", "ANA" if i % 2 else "ANA " + s * 9, f"{s}{i}", i) for i in range(6)], kind) for s in "ABC"]
    work = Labelling(spark, f"{tmp_path}/w")
    assert work.classify(tables).count() == 18
    pairs = sheets.read_sheet(spark, work.sheet_path)
    work.decide(pairs.filter("criterion = 'unconfirmed' and exp_shared = 4").select("id_a", "id_b", F.lit("match").alias("decision")))
    done = {r.text: r.entity_id for r in work.finalize().collect()}
    assert len(done) == 18 and all((done[f"A{i}"] == done[f"B{i}"] == done[f"C{i}"]) == (i % 2 == 1 or i == 4) for i in range(6))
    assert sheets.read_sheet(spark, work.sheet_path).filter("entity_id_a is not null and entity_id_b is not null").count() == 18


def test_checkpoints_and_paths(spark, tmp_path):
    for name in ("r1/epoch_01", "r1/epoch_02", "r2/best", "r2/epoch_01"):
        (tmp_path / name).mkdir(parents=True)
    at = lambda run, e=None: training.resolve_checkpoint(spark, str(tmp_path), run, e).rpartition("/")[2]
    assert (at("r1"), at("r1", 1), at("r2")) == ("epoch_02", "epoch_01", "best") and training.runs_with_best(spark, str(tmp_path)) == ["r2"]
    with pytest.raises(FileNotFoundError):
        at("r1", 9)
    paths = training.data_paths("full", str(tmp_path))
    assert set(training.missing_paths(spark, paths)) == set(paths)


def test_json_arrays_and_types(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "id int, t string").coalesce(1)
    tables.write_json_array(df, f"{tmp_path}/a", ["id"])
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*"))
    assert json.loads(text) == [{"id": 1, "t": "x"}, {"id": 2, "t": None}]
    raw = spark.createDataFrame([("1", "1.5", "a", None), (None, "2", "3", None)], "a string, b string, c string, d string")
    assert tables.inferred_types(raw) == {"a": "bigint", "b": "double", "c": "string", "d": "bigint"}


def test_profiles_and_plans(spark):
    spec = cleaning.SourceSpec(lost_letter=("n",), names=("n",), ages=("e",), keys=("x",), drop=("dx",), rename={"n": "nombre"}, name_parts=("n", "m"))
    raw = spark.createDataFrame([(" pe?a. ", "b", "3 años", "S/E", "d", "u"), (None, None, None, "12", "d", "u")], "n string, m string, e string, x string, dx string, `Unnamed: 1` string")
    got = cleaning.apply_profile(raw, "full", spec)
    assert got.columns == ["nombre", "m", "e", "x", "full_name", "n_key", "full_name_key"]
    assert [tuple(r) for r in got.collect()] == [("PEÑA", "B", 3, None, "PEÑA B", "PENA", "B PENA"), (None, None, None, 12, "", "", "")]
    gaps = profile.id_gaps(spark.createDataFrame([(1,), (2,), (2,), (9,), (25,), (None,)], "i long"), "i", 10).collect()
    assert {(r.after_id, r.next_id, r.n_missing) for r in gaps} == {(2, 9, 6), (9, 25, 15)}
    flags = profile.duplicate_flags(spark.createDataFrame([(1, None), (2, None), (3, "a")], "i int, k string"), ["k"], "i").orderBy("i").collect()
    assert [(r.duplicated, r.repeated) for r in flags] == [(True, False), (True, True), (False, False)]
    modes = profile.group_mode(spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "g int, v string"), "g", "v").collect()
    assert [(r.g, r["mode"], r.n) for r in modes] == [(1, "a", 1)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb', None), (2, "NA", "é")], "id int, t string, u string")
    tables.write_csv(df, f"{tmp_path}/c")
    back = tables.read_csv(spark, f"{tmp_path}/c", ["id", "t", "u"]).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", 'a "q"\nb', None), ("2", None, "é")]
    (tmp_path / "w.csv").write_bytes("a,b\nñ,1\n".encode("cp1252"))
    assert tables.detect_encoding(spark, f"{tmp_path}/w.csv") == "windows-1252"
    assert tables.csv_columns(spark, f"{tmp_path}/c") == ["id", "t", "u"]
    tables.write_parquet(df, f"{tmp_path}/p")
    with pytest.raises(ValueError):
        tables.read_parquet(spark, f"{tmp_path}/p", ("absent",))
    with pytest.raises(ValueError):
        tables.require_rows(df, 3)
    tables.write_json(df, f"{tmp_path}/j")
    assert tables.read_json(spark, f"{tmp_path}/j", "id int, t string, u string").count() == 2
    assert tables.schema_dictionary(spark.createDataFrame([], "a int, b array<struct<c:int,d:array<string>>>").schema) == [("a", "int"), ("b[].c", "int"), ("b[].d[]", "string")]
    assert tables.source_alias(" Econo ", {"econo": "ECONOMICO"}) == "ECONOMICO"
    assert tables.aligned(df.withColumnRenamed("id", "record_id"), df.withColumnRenamed("id", "record_id"))
    with pytest.raises(Exception, match="no entry"):
        tables.lookup_must_hit(df, spark.createDataFrame([(1, "z")], "id int, v string"), "id", "v").collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0, "2024-01-01 00:01:00"), (1, "a", 3.0, "2024-01-01 00:02:00"), (2, "b", 5.0, "2024-01-01 00:30:00")], "k int, e string, value double, ts string")
    rows.select("k", "e", "value", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema("k int, e string, value double, ts timestamp").parquet(f"{tmp_path}/s")
    for name, out, mode in (("seen", link_stream.first_sightings(stream, ["k"], "ts"), "append"), ("counts", link_stream.windowed_counts(stream, "ts", "e"), "update")):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("seen").count() == 2
    assert {(r.e, r.n, r["mean"]) for r in spark.table("counts").collect()} == {("a", 2, 2.0), ("b", 1, 5.0)}


def _line(spark, n):
    """n records, the first and the last of one entity, the others of their own; the last is the first's farthest."""
    rows = [(i, [1.0 - i / 100, 0.5], 0 if i in (0, n - 1) else i) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, entity long")


def test_reciprocal_rank_has_no_cut(spark):
    v = _line(spark, 40)
    got = retrieval.mean_reciprocal_rank(v, v).first()
    assert got.n_queries == 2 and got.mrr == round((1 / 39 + 1) / 2, 6)  # record 0 is most similar to itself and then to 1, 2...; 39 to 0


def test_separability_of_all_queries(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 1.0], 2), (51, [1.0, 1.0], 2)], "id long, embedding array<double>, entity long")
    got = retrieval.separability(v, v).first()  # no id divides by 50
    assert (got.mean_pos, got.std_pos, got.mean_neg, got.std_neg) == (1.0, 1.0, 1.0, 0.0)


def test_missing_between_ends_has_no_fixed_range(spark):
    ids = [-3, 5, 5, 190, 250, 20_000, None]
    got = sorted(r.missing for r in profile.missing_between_ends(spark.createDataFrame([(i,) for i in ids], "i long"), "i").collect())
    assert got == sorted(set(range(-3, 20_001)) - set(ids))
    assert profile.missing_between_ends(spark.createDataFrame([], "i long"), "i").count() == 0
