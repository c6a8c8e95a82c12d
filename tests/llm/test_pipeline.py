import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tarnkappe.llm import mixing, quality, queries, tokens
from tests.llm.test_minhash import by_hand
from tests.llm.test_mixing_chat import targets_by_hand

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(spark, folder):
    r = np.random.default_rng(8)
    rows = []
    for i in range(240):
        words = ["".join(r.choice(list("etaoinsh"), r.integers(2, 9))) for _ in range(r.integers(12, 160))]
        rows.append((i, " ".join(w + "%%%" for w in words) if i % 5 == 0 else " ".join(words), "en", f"s{i % 4}"))
    rows += [(1000 + i, rows[i][1] + " end", "en", "s1") for i in range(1, 60)]
    rows += [(2000, None, "en", "s0"), (2001, "", None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 240)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, outs[-1] if outs else docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        outs.append(spark.read.parquet(path))
    assert all(o.columns == docs.columns for o in outs[:-1])
    net = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {x[0]: x for x, s in zip(rows, net.scores([(x[1] or "").encode() for x in rows])) if s >= 0.5}
    assert {r.doc_id for r in outs[0].collect()} == set(good) and not any(i % 5 == 0 for i in good if i < 240) and len([i for i in good if i < 240]) == 192
    kept = {d for d, _, _, k in by_hand([x[:2] for x in good.values()], 5) if k}
    once = {r.doc_id: r for r in outs[1].collect()}
    assert set(once) == kept and not any(1000 <= d < 1060 and d - 1000 in kept for d in kept)
    sizes = Counter()
    for r in once.values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want, taken, times = targets_by_hand(sizes), Counter(), Counter()
    for r in outs[2].collect():
        n = len(WORD.findall(r.text))
        taken[r.source] += n
        times[r.doc_id] += n
        assert r.n_chars == len(r.text) and " ".join(WORD.findall(once[r.doc_id].text)).startswith(" ".join(WORD.findall(r.text)))
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and all(n <= 2 * len(WORD.findall(once[d].text)) for d, n in times.items())
    tok = tokens.encoder(queries.tokenizer_file("byte_bpe_50k.json")).tok
    pieces, runs = outs[3].collect(), defaultdict(int)
    assert sum(p.length for p in pieces) == sum(len(tok.encode(r.text).ids) + 1 for r in outs[2].collect())
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == runs[p.sequence_id]
        runs[p.sequence_id] += p.length
    assert [n for s, n in sorted(runs.items())][:-1] == [1024] * (len(runs) - 1)
    whole = corpus_pipeline.run(spark, folder)
    assert sum(p.length for p in whole.collect()) == sum(p.length for p in pieces)


def test_packing_keeps_the_order_over_files(spark, tmp_path):
    """Files of rising and falling lengths, each cut into several pieces, dealt to partitions by length."""
    r = np.random.default_rng(9)
    text = lambda n: " ".join("".join(r.choice(list("etaoinsh"), 7)) for _ in range(n))
    rows = [(i, text(3 + 60 * (i // 40 % 3)), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = f"file://{tmp_path}/mixed"
    docs.repartitionByRange(10, "doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", "4096").option("parquet.page.size", "1024").parquet(path)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for cut in ("5000", "30000", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            pieces = corpus_pipeline.packing_stage(spark, spark.read.parquet(path), "").collect()
        finally:
            for k, v in held.items():
                spark.conf.set(k, v)
        starts = sorted((p.sequence_id, p.offset, p.doc_id) for p in pieces if p.start == 0)
        assert [d for _, _, d in starts] == list(range(400)), cut


def test_written_mix_is_packed_by_position(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5 + i * 7 % 90)), "en", f"s{i % 3}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    positions = {}
    for m in mixing.mix(docs).collect():
        for c in m.copies:
            positions.setdefault(m.doc_id, []).append(c.position)
    path = f"file://{tmp_path}/mixed"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mixing_stage(spark, docs, "").write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 1
    pieces = corpus_pipeline.packing_stage(spark, spark.read.parquet(path), "").collect()
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    want = [d for _, d in sorted((x, d) for d, xs in positions.items() for x in xs)]
    assert order == want
