"""The pipeline stage by stage, each against brute force on what the stage before kept."""

import re

import corpus_pipeline
from tests.llm.test_operators import brute_bytes

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(path := f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"]: r for r in docs.collect()})
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    clean, unlike, cut, unleaked, tokens = kept
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(set(first) - set(clean)) <= len(toxic) + 5 and len(clean) >= 0.8 * len(first)
    assert all(clean[i]["text"] == first[i] for i in clean)
    sets = {}
    for i, r in clean.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    alike = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    gone = set(clean) - set(unlike)
    assert all(any(alike(i, j) for j in clean if j != i) for i in gone)
    assert not any(alike(i, j) for i in unlike for j in unlike if i < j)
    brute = brute_bytes([(i, r["text"]) for i, r in unlike.items()], 100)
    assert {i: r["text"] for i, r in cut.items()} == {i: b.decode("utf-8", "ignore") for i, b in brute.items()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bench = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in bench if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    leaks = lambda t: any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))
    assert {i for i, r in cut.items() if not leaks(r["text"])} <= set(unleaked)
    assert all(unleaked[i]["text"] == r["text"] for i, r in cut.items() if not leaks(r["text"]))
    assert set(tokens) == set(unleaked) and all(r["round_trip"] for r in tokens.values())
