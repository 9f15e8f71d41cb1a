"""The registered queries on the smallest tables, and the pipeline stage by stage against plain rules."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from tickerloom.llm import line_dedup
from tickerloom.llm.wordbpe import encoder

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op2_": ["doc_id", "held_out", "score", "predicted"], "op3_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4_": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], "op5_": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op6_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op7_": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_": ["doc_id", "line_no", "n_links", "first_doc_id", "first_line_no", "kept"], "op9_": ["doc_id", "held_out", "lang_pred", "score"], "op10_": ["doc_id", "held_out", "score", "predicted"],
    "op11_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op12_": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op13_": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_queries_answer_for_the_whole_table(spark, prefix):
    name = next(n for n in queries() if n.startswith(prefix))
    got = queries()[name](spark, SF)
    assert got.columns[:len(COLUMNS[prefix])] == COLUMNS[prefix]
    rows = got.toPandas()
    table, key = {"op6_": ("pages", "page_id"), "op12_": ("conversations", "conv_id")}.get(prefix, ("documents", "doc_id"))
    asked = spark.read.parquet(f"{SF}/{table}.parquet")
    assert set(rows[key]) == {r[0] for r in asked.select(key).collect()}
    if "score" in rows:
        assert rows.score.between(0, 1).all()


def test_stages_follow_plain_rules(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    names = docs.columns
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        docs = spark.createDataFrame(got.collect(), got.schema)
        assert docs.columns == names
        left.append({r.doc_id: r.text for r in docs.collect()})
    good, lines, single, clean = left
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i) == 1 for i in good) >= 0.95 * sum(v == 1 for v in labels.values())
    seen, expected = [], {}
    for i in sorted(good):
        mine = []
        for line in good[i].split("\n"):
            near = line.strip() and line in seen or len(line) >= 20 and any(abs(len(line) - len(x)) <= 2 and line_dedup.plain_distance(line, x) <= 2 for x in seen if len(x) >= 20 and abs(len(line) - len(x)) <= 2 and (x[:len(x) // 3] in line or x[-(len(x) // 3):] in line or x[len(x) // 3:len(x) // 3 * 2] in line))
            if not near:
                mine.append(line)
            seen.append(line)
        if mine:
            expected[i] = "\n".join(mine)
    assert lines == expected
    assert set(single) <= set(lines) and set(clean) <= set(single)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k:k + 10]) for w in (split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) for k in range(max(1, len(w) - 9)) if w}
    leaks = {i for i, t in single.items() if any(tuple(split(t)[k:k + n]) in windows for n in {len(x) for x in windows} for k in range(len(split(t)) - n + 1))}
    assert set(clean) == set(single) - leaks
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = set()
    for i, text in clean.items():
        ids = [*encoder().whole(text).tolist(), 1]
        want |= {(i, k // 4096, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[k:k + 4096]))) for k in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in packed} == want


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).where(F.col("length") > 0).count() > 0


def test_rows_that_share_an_id(spark):
    """Rows are judged by their own text: a repeated id costs no unique text, of equal rows one stays."""
    texts = {name: " ".join(f"{name}{k}" for k in range(40)) for name in "abcd"}
    long = texts["a"] + " and one more"
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(3, texts["a"]), (5, long), (5, texts["b"]), (7, texts["c"]), (7, texts["c"]), (8, None), (8, None), (None, texts["d"]), (None, texts["d"]), (9, leak), (9, texts["d"])]
    names = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").select(
        *[F.col(f.name).cast(f.dataType) for f in names])
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, docs, SF).count() <= len(rows)
    single = stages["near_duplicates"](spark, docs, SF)
    assert single.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text or "") for r in single.collect())
    assert left == sorted([(3, texts["a"]), (5, texts["b"]), (7, texts["c"]), (8, ""), (8, ""), (0, texts["d"]), (0, texts["d"]), (9, leak), (9, texts["d"])])
    clean = stages["decontamination"](spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == sorted((i or 0, t or "") for i, t in rows if t != leak)
    lines = stages["line_dedup"](spark, docs, SF)
    assert {r.text for r in lines.collect()} >= {texts["b"], texts["c"], leak}
    packed = stages["packing"](spark, docs, SF)
    assert packed.count() == len(rows)


def test_a_run_keeps_nothing_but_the_last_tables(spark, tmp_path, monkeypatch):
    from tickerloom.llm import store
    made = []
    plain = store.folder
    monkeypatch.setattr(store, "folder", lambda s, name: made.append(plain(s, name)) or made[-1])
    assert corpus_pipeline.run(spark, SF).count() > 0
    import os
    there = [os.path.basename(p).rsplit("-", 1)[0] for p in made if os.path.isdir(p.removeprefix("file:"))]
    assert "signatures" not in there and "quality" not in there and "decontamination" in there
