"""The pipeline on a small corpus, stage by stage against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from .test_llm_operators import LETTERS, _linked, _measures, lowered


def _corpus():
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choices(LETTERS, k=rng.randint(2, 8))) for _ in range(n))
    item = text(30)
    line = text(12)
    rows = [(i, text(60) + "\n" + text(40), "en", f"s{i % 4}", 0) for i in range(30)]
    rows += [(100 + i, text(40) + "\n" + line + "\n" + text(40), "en", "s1", 0) for i in range(7)]
    rows += [(200, text(50) + " " + item + " " + text(50), "en", "s2", 0), (201, "short one", "en", "s2", 0), (202, None, "en", "s3", 0)]
    base = text(150).split()
    for k in range(4):
        w = list(base)
        if k:
            w[10 * k] = "changed"
        rows.append((300 + k, " ".join(w), "en", "s0", 0))
    return rows, item, line


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rows, item, line = _corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    held = {d: t for d, t, *_ in rows}

    def after(k, docs):
        out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    docs = after(0, docs)
    assert docs.columns == columns
    kept = {d: t for d, t in held.items() if not _measures(t)[5]}
    assert {r.doc_id: r.text for r in docs.collect()} == kept
    docs = after(1, docs)
    key = lambda x: x.strip()
    owners = [d for d, t in kept.items() if line in t.split("\n")]
    kept = {d: "\n".join(x for x in t.split("\n") if key(x) != line or d == max(owners)) for d, t in kept.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {d: (t, len(t)) for d, t in kept.items()}
    docs = after(2, docs)
    groups = _linked(list(kept.items()))
    kept = {d: t for d, t in kept.items() if groups[d][1] == d}
    assert {r.doc_id for r in docs.collect()} == set(kept) and 301 not in kept and docs.columns == columns
    docs = after(3, docs)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [lowered(t)] for i in range(len(w) - 4)}
    kept = {d: t for d, t in kept.items() if 5 * len(shingles(item) & shingles(t)) < 4 * len(shingles(item))}
    assert {r.doc_id for r in docs.collect()} == set(kept) and 200 not in kept
    pieces = after(4, docs).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == set(kept)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, h string, g1 string, c1 string"


def _stage(spark, tmp_path, k, rows, items=()):
    import corpus_pipeline

    spark.createDataFrame(list(items), "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(d, t, "en", s, 0, f"row {i}", "h", "g", "c") for i, (d, t, s) in enumerate(rows)], SCHEMA)
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    if k < 4:
        assert out.columns == docs.columns
    return out


def _kept(out):
    return sorted(int(r.n_lines.split()[1]) for r in out.collect())


def test_rows_without_ids_or_with_repeated_ones_are_judged_each_by_itself(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices(LETTERS, k=rng.randint(2, 8))) for _ in range(n))
    item = text(40)
    half, other = " ".join(item.split()[:21]), " ".join(item.split()[19:])
    clean = [text(60) for _ in range(3)]
    # decontamination: two halves of an item under one id are no hit; only the row with the whole item goes
    rows = [(None, f"{clean[0]} {half}", "a"), (None, f"{other} {clean[1]}", "a"), (7, f"{clean[1]} {half}", "a"), (7, f"{other} {clean[0]}", "a"), (None, clean[2], "a"), (7, f"{clean[2]} {item}", "a"), (8, None, "a"), (8, "", "a")]
    assert _kept(_stage(spark, tmp_path, 3, rows, [(1, item), (None, "nothing of this stands in any of the texts"), (2, None)])) == [0, 1, 2, 3, 4, 6, 7]
    # near duplicates: one row of each group, whatever its ids
    near = clean[0].split()
    near = " ".join([*near[:30], "other", *near[31:]])
    far = text(60)
    rows = [(3, clean[0], "a"), (3, clean[0], "a"), (2, near, "a"), (None, clean[1], "a"), (None, clean[1], "a"), (None, far, "a"), (3, far, "b"), (None, None, "a"), (None, "", "a"), (None, "", "a"), (9, clean[2], "a"), (9, clean[2], "b"), (9, clean[1] + " and more", "a")]
    kept = _kept(_stage(spark, tmp_path, 2, rows))
    assert 2 in kept and not {0, 1} & set(kept)
    assert 12 in kept and not {3, 4} & set(kept)  # an id goes before none
    assert 6 in kept and 5 not in kept and {7, 8, 9} <= set(kept)
    assert len({10, 11} & set(kept)) == 1 and len(kept) == 7
    rows = [(None, clean[1], "a"), (None, clean[1], "a"), (None, clean[2], "b"), (None, near, None), (None, clean[0], None)]
    kept = _kept(_stage(spark, tmp_path, 2, rows))
    assert len(kept) == 3 and 2 in kept and len({0, 1} & set(kept)) == 1 and len({3, 4} & set(kept)) == 1
    # quality: one text in two hosts has a verdict in each
    rows = [(i, "short", "farm") for i in range(200)] + [(500, clean[0], "farm"), (500, clean[0], "fine"), (None, clean[1], None), (501, None, "fine")] + [(600 + i, text(60), "fine") for i in range(120)]
    kept = _kept(_stage(spark, tmp_path, 0, rows))
    assert kept == [201, 202, *range(204, 324)]
    # lines: rows that share an id count as documents each
    line = text(12)
    rows = [(i if i < 3 else None, f"{line}\n{i}", "a") for i in range(6)] + [(9, "", "a"), (None, None, "a")]
    out = {int(r.n_lines.split()[1]): (r.text, r.n_chars) for r in _stage(spark, tmp_path, 1, rows).collect()}
    assert {i: t for i, (t, _) in out.items()} == {i: (f"{line}\n{i}" if i == 2 else str(i)) for i in range(6)} | {6: "", 7: ""}
    assert all(len(t) == n for t, n in out.values())
    # packing: every row's ids, however often its id comes
    pieces = _stage(spark, tmp_path, 4, [(1, "one two", "a"), (1, "one two", "a"), (None, None, "a"), (None, text(9000), "a")]).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 1)
    assert {r.start for r in pieces if r.doc_id is None and r.doc_tokens > 1} >= {0, 2048}


def test_empty_tables_pass(spark, tmp_path):
    for k in range(5):
        assert _stage(spark, tmp_path, k, []).count() == 0
