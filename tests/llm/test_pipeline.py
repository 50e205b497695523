"""The pipeline against each stage done by brute force."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_corpus_operators import WORD, lowest
from test_edit_lines import brute as lines_by_all_pairs

import corpus_pipeline
from tamiz.llm import edit_lines, hashmix, nbsvm


def folder_of(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def corpus():
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ren", "tu") for b in ("s", "na", "pel", "x", "dor", "é")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    common = line(9)
    rows, labels = [], []
    for i in range(190):
        if i % 7 == 3:
            text = " ".join(rng.choice(["BUY!!", "$$$", "***now"]) for _ in range(30))
        elif i > 5 and i % 6 == 0:
            source = rows[rng.randrange(len(rows))][1] or ""
            text = " ".join(w if rng.random() > 0.02 else "zzz" for w in source.split(" "))
        else:
            text = "\n".join([common] * (i % 3 == 0) + [line(rng.randint(3, 25)) for _ in range(rng.randint(1, 4))])
        rows.append((i, text, None, rng.choice(["s1", "s1", "s2", "s3"]), len(text)))
        labels.append((i, int("$$$" not in text), 0))
    return [*rows, (200, None, None, None, None), (201, "", "en", "s1", 0)], labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rows, labels = corpus()
    folder = folder_of(spark, tmp_path, rows, labels)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect())

    docs, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id for r in nbsvm.quality_scores(docs, known).collect() if r.predicted}
    assert 60 <= len(good) < len(rows)
    left = {r[0]: r[1] for r in rows if r[0] in good}
    cleaned = lines_by_all_pairs(list(left.items()), edit_lines.THRESHOLD, edit_lines.MIN_BYTES)
    left = {i: cleaned[i] if cleaned[i] != (t or "") else t for i, t in left.items() if cleaned[i] == (t or "") or WORD.search(cleaned[i])}
    sets = {}
    for i, t in left.items():
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    pairs = [(a, b) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = lowest(pairs, sets)
    source = {r[0]: r[3] for r in rows}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, source[i]) for i, t in left.items() if low[i] == i])
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, size, _, _, taken in con.execute(hashmix.ORACLE_SQL).fetchall():
        ids = library.encode(left[i] or "", add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * (taken // size if size else 1)
    assert got == sorted(want)


def test_stages_keep_the_columns_and_pass_empty_tables(spark, tmp_path):
    rows, labels = corpus()
    folder = folder_of(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0, name


def test_stages_of_repeated_ids_and_clashing_names(spark, tmp_path):
    rows, labels = corpus()
    folder = folder_of(spark, tmp_path, rows, labels)
    own = ["_id", "_text", "copies", "_copy", "src", "known", "copy", "th", "gone", "_nbsvm_text", "_th", "id_of_gone", "text_of_gone", "numbers_gone"]
    one, other = "w1 w2 w3 w4 w5 w6 w7 w8", "completely different words are in this second text of the id"
    few = [(1, one, None, "s1", 0), (1, other, None, "s2", 0), (1, None, None, None, 0), (1, "", None, "s1", 0), (2, one, None, "s1", 0), (None, other, None, "s1", 0)]
    docs = spark.createDataFrame([(*r, *[k] * len(own)) for k, r in enumerate(few)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in own))
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: sorted((r["_id"], r["doc_id"], r["text"]) for r in stages[name](spark, docs, folder).select("_id", "doc_id", "text").collect())
    known = [(k, r[0], r[1]) for k, r in enumerate(few)]
    assert left("near_dedup") == [x for x in known if x[0] != 4]
    assert left("line_dedup") == [x for x in known if x[0] != 4]
    assert {x[0] for x in left("source_mix")} <= set(range(6)) and {2, 3} <= {x[0] for x in left("source_mix")}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    assert stages["encode"](spark, docs, folder).count() == 6
