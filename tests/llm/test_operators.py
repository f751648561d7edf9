"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import chat_format, components, decontaminate, kernel, minhash_forest, nn_descent, rabin_karp, rlbwt, sentencepiece_codec, toxicity, url_filter, warc
from tessera.llm.queries import TOKENIZER, op4_minhash_forest

DOCS = "doc_id long, text string, spans string, score string"


def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    base = " ".join(word() for _ in range(300))
    passage = " ".join(word() for _ in range(60))
    rows = [base, base, base.replace(" a", " zz", 2), " ".join(word() for _ in range(80)) + "\n" + passage, passage + "\t" + " ".join(word() for _ in range(50)), "", None, "one", "two words", " \n ", "ab " * 400, "é" * 3000, base.upper()]
    return [(i, t) for i, t in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def brute_bytes(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - width + 1):
            w = data[s : s + width]
            if w in seen:
                gone[s : s + width] = True
            seen.add(w)
        out[i] = data if not len(data) else bytes(np.frombuffer(data, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("width", [20, 100])
def test_rlbwt_against_brute_force(spark, width):
    got = {r["doc_id"]: rlbwt.kept_bytes(r["text"], r["spans"]) for r in rlbwt.find_repeats(frame(spark, texts()), width).collect()}
    assert got == brute_bytes(texts(), width)


def test_rlbwt_repeated_rows_nulls_and_empty(spark):
    row = "".join(chr(97 + i * i % 23 + i // 40) for i in range(150))
    rows = [(1, row), (1, row), (None, "y" * 120 + "z"), (2, "y" * 120)]
    got = rlbwt.find_repeats(frame(spark, rows), 100).collect()
    assert len(got) == 4
    assert sorted(len(rlbwt.kept_bytes(r["text"], r["spans"])) for r in got if r["doc_id"] == 1) == [0, 150]
    assert next(len(rlbwt.kept_bytes(r["text"], r["spans"])) for r in got if r["doc_id"] is None) < 121
    assert rlbwt.find_repeats(frame(spark, []), 100).count() == 0


def test_rlbwt_splits_hot_anchors(spark, monkeypatch):
    """Chunks of one text each, so that every shared anchor is hot; the passage has different neighbours in each."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(70))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40))) + passage[rng.randint(0, 5) :] + " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(40)]
    for hot in (2, 512):
        monkeypatch.setattr(rlbwt, "HOT", hot)
        monkeypatch.setattr(rlbwt, "CHUNK_BYTES", 1)
        got = {r["doc_id"]: rlbwt.kept_bytes(r["text"], r["spans"]) for r in rlbwt.find_repeats(frame(spark, rows), 60).collect()}
        assert got == brute_bytes(rows, 60)


def statistics_of(index, patterns):
    data = np.frombuffer("".join(patterns).encode(), np.uint8)
    length = np.array([len(p) for p in patterns])
    begin = np.cumsum(length) - length
    out = [[0] * len(p) for p in patterns]
    for which, at, n, pos in index.statistics(data, begin, length):
        for k, i, m, x in zip(which.tolist(), at.tolist(), n.tolist(), pos.tolist(), strict=True):
            assert m == 0 or bytes((index.codes[x : x + m] - 2).astype(np.uint8)).decode() == patterns[k][i : i + m]
            out[k][i] = m
    return out


def test_matching_statistics_against_brute_force():
    """Lengths of the longest matches; both samples of a run decide: with either of them wrong the result is wrong."""
    rng = random.Random(9)
    base = "".join(rng.choice("abc") for _ in range(60))
    texts_in = ["".join(c if rng.random() < 0.95 else rng.choice("abcd") for c in base) for _ in range(12)]
    patterns = ["".join(c if rng.random() < 0.9 else rng.choice("abcde") for c in base) for _ in range(30)]
    data, lengths = np.frombuffer("".join(texts_in).encode(), np.uint8), np.array([len(t) for t in texts_in])
    index = rlbwt.RunIndex(data, lengths)
    assert len(index.head) < len(index.codes)
    longest = lambda p: max(n for n in range(len(p) + 1) if any(p[:n] in t for t in texts_in))
    want = [[longest(p[i:]) for i in range(len(p))] for p in patterns]
    assert statistics_of(index, patterns) == want
    for name in ("start_sample", "end_sample"):
        broken = rlbwt.RunIndex(data, lengths)
        setattr(broken, name, np.zeros_like(getattr(broken, name)))
        lengths_of = [[0] * len(p) for p in patterns]
        where = np.frombuffer("".join(patterns).encode(), np.uint8)
        size = np.array([len(p) for p in patterns])
        for which, at, n, _ in broken.statistics(where, np.cumsum(size) - size, size):
            for k, i, m in zip(which.tolist(), at.tolist(), n.tolist(), strict=True):
                lengths_of[k][i] = m
        assert lengths_of != want


@pytest.mark.parametrize("leading", [None, 2])
def test_rabin_karp_against_brute_force(spark, monkeypatch, leading):
    """With 2 leading bytes the first count proposes many windows that the second takes back."""
    if leading:
        monkeypatch.setattr(rabin_karp, "key_bytes", lambda n: leading)
    rows, width = texts(), 5
    words = {i: (t or "").encode().split() for i, t in rows}
    count: dict = {}
    for w in words.values():
        for s in range(len(w) - width + 1):
            count[tuple(w[s : s + width])] = count.get(tuple(w[s : s + width]), 0) + 1
    want = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - width + 1):
            if count[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = True
        want[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    got = {r["doc_id"]: rabin_karp.kept_words(r["text"], r["spans"]) for r in rabin_karp.repeated_windows(frame(spark, rows), width).collect()}
    assert got == want
    assert rabin_karp.repeated_windows(frame(spark, []), width).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rows = texts()
    rows += [(20, " ".join(f"w{i}" for i in range(50))), (21, " ".join(f"w{i}" for i in range(52))), (None, "one"), (7, "one")]

    def shingles(t, n):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}).encode())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    for width in (4, 5):
        sets = {i: shingles(t, width) for i, t in rows if i is not None}
        root = {i: i for i in sets}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = minhash_forest.near_duplicates(frame(spark, rows), width).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    assert minhash_forest.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """900 texts at 0.765 (78 of 102 words) share prefixes; chains of 3 with links at 0.80 run through them."""
    common = [f"c{i}" for i in range(78)]
    rows = []
    for i in range(900):
        own = [f"l{i}x", f"l{i}y"] if i % 3 else []
        own += [f"l{i + 1}x", f"l{i + 1}y"] if i % 3 < 2 else []
        rows.append((i, " ".join(common + own + [f"o{i}w{k}" for k in range(12 - len(own))])))
    sets = [set(t.split()) for _, t in rows]
    alike = {(a, b) for a in range(900) for b in range(a + 1, 900) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert alike == {(i, i + 1) for i in range(900) if i % 3 < 2}
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(frame(spark, rows), 1).collect()}
    assert got == {i: i - i % 3 for i in range(900)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {100: 100, 101: 100, 200: 100}


def test_decontamination(spark, monkeypatch):
    passage = "The quick, brown fox jumps over the lazy dog again and again today"
    rows = [(1, "clean words only " * 20), (2, f"before. {passage.upper()}! after it"), (3, "short item"), (4, None), (5, ""), (2, f"before. {passage.upper()}! after it")]
    bench = spark.createDataFrame([(10, passage), (11, "Short ITEM"), (12, None), (13, "..."), (14, passage)], "item_id long, text string")
    for small in (decontaminate.BROADCAST_BYTES, 100):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", small)
        found = decontaminate.find_leaks(frame(spark, rows), bench)
        got = {r["doc_id"]: r for r in found.collect()}
        assert got[1]["n_hit"] == 0 and got[4]["n_words"] == 0 and got[5]["items"] == []
        assert (got[2]["n_hit"], got[2]["items"]) == (13, ["10", "14"])
        assert (got[3]["n_hit"], got[3]["items"]) == (2, ["11"])
        kept = {r["doc_id"]: r["text"] for r in decontaminate.without_leaks(found, 0.9).collect()}
        assert kept == {1: rows[0][1], 2: "before. ! after it", 4: None, 5: ""}
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_items_are_distinct_ids(spark, monkeypatch):
    docs = frame(spark, [(1, "a b c"), (None, "a b c d"), (2, "x y z w")])
    bench = spark.createDataFrame([(1, "a b c"), (1, "A b c"), (None, "x y z"), (1, "c d")], "item_id long, text string")
    for small in (decontaminate.BROADCAST_BYTES, 20):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", small)
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_leaks(docs, bench).collect()}
        assert got == {1: (3, ["1"]), None: (4, ["1"]), 2: (3, [])}


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("com", "/en/", "block")], "host string, path string, verdict string")
    urls = {"http://EXAMPLE.com/en/77?x": ("example.com/en/7", "allow"), "https://a.b.com/en/": ("com/en/", "block"), "http://com/EN/": (None, "allow"), "http://xcom/en/": (None, "allow"), "nothing": (None, "allow"), None: (None, "allow"), "http://.com/en/#?": ("com/en/", "block"), "x://h" + "/p" * 5000: (None, "allow")}
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, r_host string, label string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == urls
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\n" * 3000), (None, "n", "n"), (2, None, "<p>é</p>")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=str)
    want = [(1, "revisit", 2, 9), (2, "response", None, 9), (2, "response", None, 9), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 45000), (None, "response", None, 1)]
    assert by == sorted(want, key=str)
    long = next(r for r in got if r["page_id"] == 5)
    assert long["payload"].decode() == rows[4][2] and long["payload_digest"] == warc.base32_sha1(rows[4][2].encode())
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat_round_trip(spark):
    hard = "a\\b</s>[INST] <s> [/INST]\n\\[\\<"
    rows = [(1, 0, "system", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 3, "assistant", ""), (1, 4, "to ol\n|", "x" * 5000), (2, 0, None, ""), (None, 0, "assistant", "<"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    examples = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    from pyspark.sql import functions as F

    out = examples.withColumns({"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("mask_start"), F.col("mask_chars"))}).collect()
    one = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [r["loss"] for r in one] == [hard, "", ""]
    assert [(t["role"], t["text"]) for t in one[-1]["turns"]] == [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert {r["conv_id"]: len(r["turns"]) for r in out if r["conv_id"] != 1} == {2: 1, None: 1, 3: 2}


def test_toxicity(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green", "tree", "house"]) for _ in range(30)) + (" you awful brute" if i % 4 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (401, None)], "doc_id long, label int")
    docs = frame(spark, [*rows, (1000, None), (1001, ""), (None, "awful brute")])
    weights = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400, 600))
    assert got[1000] == got[1001] and 0 <= got[1000] <= 1
    assert {r["score"] for r in toxicity.score(docs.limit(5), toxicity.train(docs, labels.limit(0))).collect()} == {0.5}


def test_toxicity_against_plain_ftrl(spark):
    """The weights of a plain FTRL-proximal over dictionaries, one row after the other."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green", "awful", "brute", "tree"]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(3, rows[3][1]), (7, "another text"), (500, None)]
    labels = [(i, int("awful brute" in (t or ""))) for i, t in rows[:110]] + [(500, 1), (3, 0)]
    label = {}
    for i, y in labels:
        label[i] = max(y, label.get(i, 0))
    learnt = []
    for i, t in rows:
        if i in label:
            batch = pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"])
            learnt.append((toxicity.hash_of(str(i)), toxicity.packed(toxicity.by_text(batch)[0]), label[i], toxicity.by_text(batch)[0].tolist()))
    learnt.sort(key=lambda x: x[:2])
    f = toxicity.Ftrl()
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(z, n, l1):
        return 0.0 if abs(z) <= l1 else -(z - (l1 if z > 0 else -l1)) / ((f.beta + n**0.5) / f.alpha + f.l2)

    for _ in range(4):
        for _, _, y, features in learnt:
            w = {k: weight(z.get(k, 0.0), n.get(k, 0.0), f.l1) for k in features}
            b = weight(bias[0], bias[1], 0.0)
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y
            for k in features:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / f.alpha * w[k]
                n[k] = old + g * g
            bias[0] += g - ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / f.alpha * b
            bias[1] += g * g
    want = {k: weight(z[k], n[k], f.l1) for k in z} | {-1: weight(bias[0], bias[1], 0.0)}
    got = dict(toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, label int")))
    assert set(got) == {k for k, w in want.items() if w} | {-1} and len(got) >= 3
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert toxicity.score(frame(spark, []), list(got.items())).count() == 0
    assert toxicity.train(frame(spark, []), spark.createDataFrame(labels, "doc_id long, label int")) == []


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0, None] + [0.0] * 6, 1), (None, x[0].tolist(), 1)]
    got: dict = {}
    for r in nn_descent.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 300, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(300), d)).tolist() if i != q][:10]
        hit += len(set(order) & {v for v, _ in got[q]})
        assert all(abs(s - d[v]) < 1e-9 for v, s in got[q])
    assert set(got) == set(range(0, 300, 50)) and hit >= 0.9 * 60
    assert [v for v, _ in got[50]] == list(range(51, 61))


def test_sentencepiece(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model, decoder = sentencepiece_codec.loaded(TOKENIZER)
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    rng = random.Random(2)
    some = [t for _, t in texts()] + ["".join(rng.choice("ab  \n\té漢😀<s>the 12") for _ in range(rng.randint(0, 90))) for _ in range(200)] + ["x" * 4000, "the" * 100, "   "]
    ids, cuts = sentencepiece_codec.encode_batch(model, some)
    for i, t in enumerate(some):
        own = ids[cuts[i] : cuts[i + 1]].tolist()
        assert own == library.encode(t or "")
    assert [x.decode() for x in decoder.decode_batch(ids, cuts)] == [t or "" for t in some]
    docs = frame(spark, list(enumerate(some)))
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, TOKENIZER), TOKENIZER).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    for r in sentencepiece_codec.summaries(docs, TOKENIZER).collect():
        assert r["round_trip"] and r["decoded_sha256"] == hashlib.sha256((some[r["doc_id"]] or "").encode()).hexdigest()


def merged_one_by_one(model, text):
    """BPE as it is defined: the best pair of neighbours that makes a piece, leftmost of equals, until there is none."""
    parts = list(sentencepiece_codec.prepared(model, text))
    while True:
        found = [(-model.scores[model.number[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.number]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [i for p in parts for i in ([model.number[p]] if p in model.number else model.fallback(ord(p)))]


def test_bpe_table_against_merging():
    model, _ = sentencepiece_codec.loaded(TOKENIZER)
    rng = random.Random(8)
    pieces = list(model.number)
    some = ["".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    some += [" " * n + end for n in range(40) for end in ("", "a", "漢")] + ["".join(rng.choice("abes") for _ in range(120)) for _ in range(5)]
    ids, cuts = sentencepiece_codec.encode_batch(model, some)
    for i, t in enumerate(some):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == merged_one_by_one(model, t), t


def test_sentencepiece_nulls_repeats_and_empty(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, "")]
    got = sentencepiece_codec.summaries(frame(spark, rows), TOKENIZER).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert sentencepiece_codec.summaries(frame(spark, []), TOKENIZER).count() == 0
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark, []), TOKENIZER), TOKENIZER).count() == 0


def test_unigram_viterbi(tmp_path):
    """A unigram model made of a few pieces, against every segmentation."""
    import struct

    scores = {"▁": -2.0, "a": -3.0, "b": -3.1, "ab": -3.7, "▁a": -3.3, "ba": -4.05, "aba": -5.9, "<unk>": 0.0}

    def part(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    data = b""
    for p, s in scores.items():
        data += part(1, part(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, 2 if p == "<unk>" else 1]))
    data += part(2, bytes([3 << 3, 1])) + part(3, bytes([4 << 3, 0]))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    model = sentencepiece_codec.Model(str(path))

    def best(t):
        if not t:
            return 0.0
        return max(scores[t[:n]] + best(t[n:]) for n in range(1, len(t) + 1) if t[:n] in scores)

    for t in ("abab", "aab", "b a ab", "ababab ba", "a" * 12):
        ids, _ = sentencepiece_codec.encode_batch(model, [t])
        assert "".join(model.pieces[i] for i in ids) == "▁" + t.replace(" ", "▁")
        assert abs(sum(model.scores[i] for i in ids) - best("▁" + t.replace(" ", "▁"))) < 1e-5


def test_words_are_split_as_patterns_say():
    t = ["A b\tc", None, "x-1 é.Z", " "]
    spaced = kernel.of_column(pa.array(t), kernel.SPACE, False)
    alnum = kernel.of_column(pa.array(t), kernel.NOT_ALNUM, True)
    assert spaced.counts.tolist() == [3, 0, 2, 0] and alnum.counts.tolist() == [3, 0, 4, 0]
    assert alnum.text(3, 4) == [b"x", b"1", "é".encode(), b"Z"]


def test_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a", "x", "c", "c"), (2, None, "x", "c", "c")], "page_id long, url string, html string, digest string, response string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None)}
    turns = spark.createDataFrame([(1, 0, "assistant", "hi", "c", "c")], "conv_id long, turn long, role string, text string, turns string, example string")
    assert [r["formatted"] for r in chat_format.format_chats(turns).collect()] == ["<s>hi</s>"]
    assert chat_format.format_chats(turns.limit(0)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nn_descent.nearest_neighbours(none).count() == 0


def test_nearest_neighbours_with_ties_and_repeated_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(-4, 5)] + [(0, [0.0, 1.0]), (100, [0.0, 1.0])]
    got = [(r["rank"], r["vec_id"], r["score"]) for r in nn_descent.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, k=3).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(1, 100, 0.0), (2, -1, 1.0), (3, 1, 1.0)]


def test_near_duplicate_query_has_the_columns_of_its_sql(spark):
    found = op4_minhash_forest(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
