from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from convspark.operators import evaluation as ev, knn
from convspark.sources import eval_runs, vector_table


def vectors(spark, n=300, dim=8, seed=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dim))
    points = centres[rnd.integers(0, 6, n)] + 0.3 * rnd.normal(size=(n, dim))
    points[: n // 3] = points[0]  # a third of the rows are copies of one vector
    points[-1] = 0
    rows = [(i, i % 3, i, f"Reply {i % 40}{'!' if i % 2 else ''}", [float(x) for x in p]) for i, p in enumerate(points)]
    return rows, spark.createDataFrame(rows, "pair_id bigint, chat_id bigint, ts bigint, reply string, embedding array<float>")


def unit(v):
    v = np.array(v, dtype="float32").astype("float64")
    return v / (np.linalg.norm(v) or 1.0)


def brute(rows, queries, k, overfetch, same_chat):
    out = {}
    for qid, qchat, before, emb, exclude in queries:
        q = unit(emb)
        hits = sorted(
            (round(float(1 - q @ unit(r[4])), 6) + 0.0, r[0], "".join(c for c in r[3].lower() if c.isalnum()))
            for r in rows
            if (before is None or r[2] < before) and (not same_chat or r[1] == qchat) and r[0] not in exclude
        )[: k * overfetch]
        seen, kept = set(), []
        for d, pid, key in hits:
            if key not in seen:
                seen.add(key)
                kept.append((pid, d))
        out[qid] = kept[:k]
    return out


@pytest.mark.parametrize("pivots,same_chat", [(None, False), (12, False), (40, True)])
def test_knn_is_exact(spark, monkeypatch, pivots, same_chat):
    monkeypatch.setattr(knn, "TILE_VECTORS", 16)
    monkeypatch.setattr(knn, "TILE_QUERIES", 4)
    rows, index = vectors(spark)
    asked = [(r[0], r[1], r[2] if i % 2 else 10**9, r[4], [r[0]]) for i, r in enumerate(rows[:: 17] + rows[-1:])]
    queries = spark.createDataFrame(asked, "query_id bigint, chat_id bigint, ts_before bigint, embedding array<float>, exclude array<bigint>")
    got = {}
    for r in knn.knn_join(queries, index, 5, 4, same_chat, pivots).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["pair_id"], r["distance"]))
    expected = {q: hits for q, hits in brute(rows, asked, 5, 4, same_chat).items() if hits}
    assert got.keys() == expected.keys()
    for q in expected:
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in expected[q]], abs=2e-6)


@pytest.mark.parametrize("same_chat,pivots,text_ids", [(False, None, False), (True, 9, True)])
def test_nearest_over_many_blocks(spark, monkeypatch, same_chat, pivots, text_ids):
    """Ids are those of a brute-force search also among many copies, and no vector is shuffled to the queries or the other way
    round: what is moved grows with the vectors, not with the pairs of blocks."""
    for name, value in (("TILE_VECTORS", 16), ("STRIP", 8), ("SAMPLE", 12), ("TASKS", 40)):
        monkeypatch.setattr(knn, name, value)
    rnd = np.random.default_rng(3)
    points = rnd.integers(-2, 3, (240, 4)).astype(float)
    points[20:120] = points[20]
    name = lambda i: f"p{i:04d}" if text_ids else i
    rows = [(name(i), i % 2 if i % 31 else None, None if i % 41 == 5 else i, p.tolist()) for i, p in enumerate(points)]
    asked = [(name(i), i % 2, i + 60, rows[i][3], [name(i), name(i + 2)] if i % 3 else None) for i in range(0, 240, 3)]
    kind = "string" if text_ids else "bigint"
    index = spark.createDataFrame(rows, f"pair_id {kind}, chat_id bigint, ts bigint, embedding array<float>")
    queries = spark.createDataFrame(asked, f"query_id {kind}, chat_id bigint, ts_before bigint, embedding array<float>, exclude array<{kind}>")
    hits = knn.nearest(queries, index, 7, same_chat, pivots)
    assert hits.columns == ["query_id", "pair_id", "chat_id", "ts", "distance", "hit"]
    expected = []
    for q, chat, before, vector, gone in asked:
        fit = [(round(float(1 - unit(vector) @ unit(e)), 6) + 0.0, i) for i, c, ts, e in rows if ts is not None and ts < before and (not same_chat or c == chat) and i not in (gone or ())]
        expected += [(q, n, i) for n, (_, i) in enumerate(sorted(fit)[:7], 1)]
    assert sorted((r["query_id"], r["hit"], r["pair_id"]) for r in hits.collect()) == sorted(expected)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan


@pytest.mark.parametrize("same_chat", [False, True])
def test_probed_search_recall(spark, same_chat):
    """Hits obey the filters, and their distances are those of the exact search for nine of ten or more."""
    _, index = vectors(spark, 900, 16, 5)
    queries = index.select(F.col("pair_id").alias("query_id"), "chat_id", F.col("ts").alias("ts_before"), "embedding").where("pair_id % 20 = 0 and pair_id > 100")
    exact = {(r["query_id"], r["hit"]): r["distance"] for r in knn.nearest(queries, index, 10, same_chat).collect()}
    found = knn.nearest_probed(queries, index, 10, same_chat, tables=10, bits=5, probes=4).collect()
    ids = {r["pair_id"]: r["chat_id"] for r in index.select("pair_id", "chat_id").collect()}
    assert all(r["ts"] < r["query_id"] and (not same_chat or r["chat_id"] == ids[r["query_id"]]) for r in found)
    assert len({(r["query_id"], r["pair_id"]) for r in found}) == len(found)
    same = sum(abs(r["distance"] - exact[r["query_id"], r["hit"]]) < 1e-6 for r in found)
    assert same >= 0.9 * len(exact)


def test_k_zero_and_empty_index(spark):
    _, index = vectors(spark, 30)
    queries = index.select(F.col("pair_id").alias("query_id"), "embedding").limit(3)
    assert knn.knn_join(queries, index, 0).count() == 0
    assert knn.knn_join(queries, index.where("false"), 3).count() == 0


def test_index_and_query_text(spark):
    turns = "array<struct<is_me: boolean, text: string>>"
    df = spark.createDataFrame([([(False, "a"), (True, "x"), (False, "b"), (False, "c")],), ([(True, "x"), (True, "y"), (True, "z")],)], f"c {turns}")
    assert [r[0] for r in df.select(knn.index_text(F.col("c"))).collect()] == ["b\nc", "y\nz"]
    q = spark.createDataFrame([("p", "i"), (None, "i")], "p string, i string")
    assert [r[0] for r in q.select(knn.query_text(F.col("p"), F.col("i"))).collect()] == ["p\ni", "i"]


def pair_table(spark):
    context = "array<struct<sender_name: string, is_me: boolean, text: string>>"
    rows = [(f"1:{i}", 1, "1:0", i, "2024-01", f"ответ {i}", [("p", False, f"вопрос {i}")], False) for i in range(30)]
    return spark.createDataFrame(rows, f"pair_id string, chat_id bigint, conversation_id string, ts bigint, period string, reply string, context {context}, eval_sample boolean")


def test_build_index(spark, tmp_path):
    pairs, path = pair_table(spark), str(tmp_path / "index")
    identity = vector_table.EmbeddingIdentity("local", "hash", 16)

    def embed(df):
        return df.withColumn("embedding", vector_table.hashed_features(F.col("document"), 16))

    vector_table.build_index(pairs, path, embed, identity, "v1")
    index = vector_table.open_index(spark, path, identity)
    assert index.count() == 30
    assert abs(sum(x * x for x in index.first()["embedding"]) - 1) < 1e-5
    with pytest.raises(Exception, match="(?i)already exists"):
        vector_table.build_index(pairs, path, embed, identity, "v1")
    vector_table.build_index(pairs.where("ts < 10"), path, embed, identity, "v2", rebuild=True)
    assert vector_table.open_index(spark, path, identity).count() == 10
    with pytest.raises(ValueError, match="index built with"):
        vector_table.open_index(spark, path, vector_table.EmbeddingIdentity("local", "other", 16))
    with pytest.raises(Exception, match="evaluation pairs"):
        vector_table.build_index(pairs.withColumn("eval_sample", F.lit(True)), str(tmp_path / "no"), embed, identity, "v1")


def test_embed_column_batches(spark):
    def lengths(texts):
        assert len(texts) <= 4
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(11)], "i int, t string")
    got = vector_table.embed_column(df, "t", lengths, batch=4, prefix="query: ").orderBy("i").collect()
    assert [r["embedding"][0] for r in got] == [7.0 + max(i, 1) for i in range(11)]
    with pytest.raises(Exception, match="vectors for"):
        vector_table.embed_column(df, "t", lambda texts: [[0.0]], batch=4).collect()


def judge(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, judge_raw string")
    return ev.judged_records(df).orderBy("i").collect()


def answer(a, b='"consistency": 4'):
    return '{"style_similarity": %s, "appropriateness": {"score": 2, "reason": "x"}, "not_assistant_like": 5, %s}' % (a, b)


def test_judge_parsing(spark):
    rows = judge(spark, ["текст " + answer("3") + " конец", answer("9"), answer("true"), "нет", answer("4.7"), answer('"3"'), answer("0.5"), answer("3", '"x": 1'), "{oops}"])
    assert [r["judge_error"] for r in rows] == [
        None, "bad_score:style_similarity", "bad_score:style_similarity", "no_json", None, "bad_score:style_similarity",
        "bad_score:style_similarity", "bad_score:consistency", "no_json"]
    assert (rows[0]["style_similarity"], rows[0]["appropriateness"], rows[4]["style_similarity"]) == (3, 2, 4)
    assert rows[1]["appropriateness"] is None


def test_duels_and_sign_test(spark, one):
    votes = [("1", '{"winner": "2"}', '{"winner": "1"}'), ("2", '{"winner": 1}', '{"winner": "1"}'), ("3", '{"winner": "2"}', 'x {"winner": " 1 "} y'), ("4", "no", '{"winner": "4"}')]
    got = ev.duel_records(spark.createDataFrame(votes, "pair_id string, a_first string, b_first string")).orderBy("pair_id").collect()
    assert [r["outcome"] for r in got] == ["b", "tie", "b", "tie"] and [r["has_error"] for r in got] == [False, False, False, True]
    for wins, losses in ((0, 10), (5, 5), (0, 0), (19, 9), (15, 14), (300, 220), (3, 1000), (40000, 40500)):
        n = wins + losses
        tail = sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) if n < 5000 else None
        expected = 1.0 if n == 0 else min(1.0, 2 * tail / 2**n) if tail is not None else 0.0787
        assert one(ev.sign_test_p(F.col("w"), F.col("l")), w=wins, l=losses) == pytest.approx(round(expected, 4), abs=3e-4)


def test_run_documents(spark, tmp_path):
    folder = tmp_path / "runs"
    folder.mkdir()
    doc = '{"metadata": {"run_id": "r%d", "started_at": "2024", "mode": "rag", "n": 1}, "summary": {"n": 1}, "records": [{"pair_id": "1:1", "latency_ms": 5, "judge": {"scores": {"style_similarity": 3, "appropriateness": 3, "not_assistant_like": 3, "consistency": 3}}}]}'
    (folder / "r1_a.json").write_text(doc % 1)
    (folder / "r2_a.json").write_text(doc % 2)
    (folder / "compare.json").write_text('{"metadata": null}')
    documents = eval_runs.read_run_documents(spark, str(folder))
    assert {r["run_id"] for r in eval_runs.run_metadata(documents).collect()} == {"r1", "r2"}
    assert ev.judged_records(eval_runs.run_records(documents)).where("judged").count() == 2
    assert eval_runs.find_run(documents, "r1").count() == 1
    with pytest.raises(Exception, match="matches 2"):
        eval_runs.find_run(documents, "r").collect()
    meta = eval_runs.run_metadata(documents).where("run_id = 'r1'").drop("file")
    eval_runs.write_run(meta, spark.createDataFrame([("1:1", 5)], "pair_id string, latency_ms bigint"), str(tmp_path / "out"))
    assert eval_runs.read_run_documents(spark, str(tmp_path / "out")).count() == 1
