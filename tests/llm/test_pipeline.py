import hashlib
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from attesta.llm import quality
from tests.llm import test_decontaminate as decon
from tests.llm import test_simhash as sim
from tests.llm import test_substring_dedup as sub


def tables(path, spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, labels = [], []
    passage, items = say(90), [(i, say(20)) for i in range(5)]
    for i in range(240):
        text = say(rng.randint(30, 120))
        if i % 5 == 0:
            text = " ".join(w + "***" for w in text.split())
        elif i % 7 == 0:
            text += " " + passage + " " + say(20)
        elif i % 11 == 0:
            text += "\n" + items[i % 5][1].upper() + "!\n" + say(9)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 5 > 0), 0))
    docs += [(1000 + i, docs[i][1], "en", "s", 1) for i in range(1, 40)] + [(2000, "short", "en", "s", 5), (2001, None, None, None, None)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return docs, items


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items = tables(tmp_path, spark)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, step = frame.columns, None
    kept = [(i, t) for i, t, *_ in docs]

    rules = quality.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    stats = {r.doc_id: r.kept for r in quality.judged(frame, rules).collect()}
    kept = [(i, t) for i, t in kept if stats[i]]
    step = P.quality_rules(spark, frame, str(tmp_path))
    assert step.columns == columns and sorted(r.doc_id for r in step.collect()) == sorted(i for i, _ in kept)
    assert len(kept) > 150

    want, _ = sim.expect(kept)
    kept = [(i, t) for (i, t), (_, _, c) in zip(kept, want) if i == c]
    step = P.near_dedup(spark, step, str(tmp_path))
    assert step.columns == columns and sorted(r.doc_id for r in step.collect()) == sorted(i for i, _ in kept)

    cut = {w[0]: w[4] for w in sub.brute(kept, 50)}
    step = P.passage_dedup(spark, step, str(tmp_path))
    rows = step.collect()
    assert step.columns == columns and {r.doc_id: r.text.split() for r in rows} == cut
    assert all(r.n_chars == len(r.text) for r in rows) and any(len(cut[i]) < len(t.split()) for i, t in kept)

    left = [(r.doc_id, r.text) for r in rows]
    hit = {r[0] for r in decon.brute(left, items) if r[5]}
    step = P.decontamination(spark, step, str(tmp_path))
    assert hit and step.columns == columns and {r.doc_id for r in step.collect()} == {i for i, _ in left} - hit

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len(ids := tok.encode(t, add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in left if i not in hit)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in P.run(spark, str(tmp_path)).collect()) == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, root int, cuts string, stats int, items int"


def write(spark, path, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [])
    assert P.run(spark, str(tmp_path)).collect() == []


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(15)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long = say(30_000)
    more = ("x", "y", 1, "z", 2, 3)
    texts = {1: say(40), 2: say(50), 3: say(60), 4: "Alpha beta gamma delta epsilon zeta eta theta iota kappa " + say(40), 5: long}
    docs = [(i, t, "en", "s", 1, *more) for i, t in texts.items()] + [(9, texts[2], "en", "s", 1, *more), (2, texts[2], "en", "s", 1, *more), (None, texts[1], None, None, None, *[None] * 6), (None, say(45), None, None, None, *[None] * 6), (7, None, "en", "s", 1, *more), (8, "", "en", "s", 1, *more)]
    write(spark, tmp_path, docs)
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    rows = step.collect()
    assert sorted((r.doc_id for r in rows), key=str) == [1, 2, 3, 5, None] and all(tuple(r)[5:] == more for r in rows if r.doc_id)
    assert sorted(map(str, (r.doc_id for r in P.run(spark, str(tmp_path)).collect()))) == ["1", "2", "3", "5", "None"]


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data operators the entry points import and name their queries."""
    root = Path(P.__file__).parent
    for name in ("attesta", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "attesta" / "llm")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q) and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
