"""Small tests of the training-data operators: brute-force versions, round trips and odd inputs."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from strandspark.llm import attention, bpe, chat, common, fertility, flac, lines, mixing, sharding, shingles, simhash, suffix
from strandspark.llm.components import connected_components

KIND = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(11)
WORDS = ["the", "of", "thand", "erin", "ouhe", "stha", "Reat", "ing", "be", "là", "été", "123", "x-y", "it's"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(400)
    out = [base, base, base[:900] + " zz " + base[900:], prose(60), prose(60) + "\n" + base[100:700], None, "", " ", "a", "a" * 700, "besten, " * 120, "日本語 テスト ½", "\n\n a  b\t\x1c ", "it's we'll <|endoftext|> don't!!", "é" * 300]
    return {i: t for i, t in enumerate(out)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Odd texts, a repeated row, a row without id, and an extra column whose name clashes with an output."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i == 3 else f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    rows += [rows[3], (None, "no id here", "en", "s1", 10)]
    return spark.createDataFrame(rows, KIND).withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_repeats(texts, size=100):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w in seen:
                covered[p : p + size] = b"\1" * size
            seen.add(w)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out[i] = (len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(docs, texts, empty):
    rows = suffix.remove_repeats(docs, 100).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    want = brute_repeats(texts)
    assert len(rows) == len(texts) + 2 and {k: v for k, v in got.items() if k is not None} == want
    assert suffix.remove_repeats(empty, 100).count() == 0


def test_repeats_of_short_texts_and_shared_ids(spark):
    kind = "doc_id long, text string"
    short = spark.createDataFrame([(1, "short"), (2, ""), (3, None)], kind).coalesce(1)
    assert [(r["n_bytes"], r["n_removed"]) for r in suffix.remove_repeats(short).orderBy("doc_id").collect()] == [(5, 0), (0, 0), (0, 0)]
    a, b = "".join(RNG.choice("abcdef ") for _ in range(700)), "".join(RNG.choice("qxzjkv ") for _ in range(700))
    for one, two in ((2, 3), (2, 2), (None, None)):
        rows = [(1, a), (one, "zz " + a), (two, b), (9, "short"), (one, "zz " + a)]
        got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(spark.createDataFrame(rows, kind).repartition(3)).collect())
        assert got == sorted([(700, 0, 0), (703, 700, 1), (703, 700, 1), (700, 0, 0), (5, 0, 0)])


def test_repeats_of_a_very_long_text(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(400_000))
    texts = {1: base, 2: "x" + base[100_000:350_000] + "y", 3: base[:50] * 3_000}
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in by_id(suffix.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).items()}
    assert got == brute_repeats(texts)


def test_repeats_of_many_variants(spark):
    base = prose(200)
    var = {i: "".join(c if RNG.random() > 0.004 else "#" for c in base) for i in range(60)}
    df = spark.createDataFrame(list(var.items()), "doc_id long, text string").repartition(4)
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in by_id(suffix.remove_repeats(df)).items()}
    assert got == brute_repeats(var)


def test_run_length_index_statistics():
    data = [b"abracadabra", b"cadabrac", b"", b"zzzz"]
    index = suffix.RunLengthIndex(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 4)
    joined = [*b"abracadabra", -1, *b"cadabrac", -2, -3, *b"zzzz", -4]
    assert index.run_length.sum() == len(joined) and len(index.run_symbol) < len(joined)
    found = index.repeats(np.arange(len(joined)))
    want = [p for p in range(len(joined)) if min(joined[p : p + 4], default=-1) >= 0 and len(joined[p : p + 4]) == 4 and any(joined[q : q + 4] == joined[p : p + 4] for q in range(p))]
    assert found.tolist() == want


def test_suffix_order_sorts_only_what_is_open(monkeypatch):
    rng, sorted_, argsort = random.Random(41), [], np.argsort
    texts = [bytes(rng.choices(b"abcd", k=60)) * rng.choice([1, 1, 2]) for _ in range(40)] + [b"", b"a" * 50]
    symbol = np.array([x for i, t in enumerate(texts) for x in [*(c + len(texts) for c in t), i]])
    monkeypatch.setattr(np, "argsort", lambda x, *more, **named: sorted_.append(len(x)) or argsort(x, *more, **named))
    order = suffix.RunLengthIndex._suffix_order(symbol, 121)
    assert order.tolist() == sorted(range(len(symbol)), key=lambda i: symbol[i:].tolist())
    assert sum(sorted_) < 4 * len(symbol)  # 8 or so times before


@pytest.mark.parametrize("pattern, common, task_words", [(P.PATTERN, bpe.COMMON_WORDS, bpe.TASK_WORDS), (P.PATTERN, 5, 40), (r"[\n!-/]+|\w+|[^\n!-/\w]+", 5, 40)])
def test_bpe_equals_tiktoken(spark, docs, texts, empty, monkeypatch, pattern, common, task_words):
    monkeypatch.setattr(bpe, "COMMON_WORDS", common)
    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    long = {100: " ".join(f"Word{i * 7919 % 30011}" for i in range(60_000)), 101: "x" * 4_000 + "\n" + "ab" * 300}
    df = docs.unionByName(spark.createDataFrame(list(long.items()), "doc_id long, text string"), allowMissingColumns=True)
    rows = bpe.encode_documents(df, path, pattern, keep_ids=True, chunk_bytes=500, task_words=task_words).collect()
    assert len(rows) == len(texts) + 4 and sum(r["doc_id"] is None for r in rows) == 1
    got = {r["doc_id"]: r for r in rows}
    for i, t in (texts | (long if pattern == P.PATTERN else {})).items():
        ids = own.encode_ordinary(t or "")
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, path, pattern).count() == 0


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_lines_tell_keys_once(spark, monkeypatch):
    """Not once more in a filter, which the optimiser makes of a condition on them."""
    plans, saved = [], lines.save

    def save(df, name):
        plans.extend([df._jdf.queryExecution().optimizedPlan()] if name == "line-words" else [])
        return saved(df, name)

    monkeypatch.setattr(lines, "save", save)
    out = lines.dedup_lines(spark.createDataFrame([(1, "a b c d e f\na b c\na b c d"), (2, "A b c d e f\na b\na b c d e")], "doc_id long, text string"))
    assert {(r.doc_id, r.n_removed) for r in out.collect()} == {(1, 1), (2, 2)}
    conditions = [line for line in plans[0].toString().split("\n") if "Filter" in line.split("(")[0]]
    assert conditions and not any("xxhash64" in line for line in conditions)


def test_driver_gives_back_freed_memory(spark, tmp_path, monkeypatch):
    from strandspark.llm import common

    done = []
    given = common.give_back_driver
    monkeypatch.setattr(common, "_gave_back", float("-inf"))
    monkeypatch.setattr(common, "give_back_driver", lambda s: done.append(given(s)))
    monkeypatch.setattr(common, "shared_dir", lambda s: str(tmp_path))
    common.save(spark.range(3), "some")
    common.save(spark.range(3), "more")
    assert done == [True, False]  # the second comes within seconds


def test_plans_are_described_briefly(spark):
    """A rank map in a plan does not reach the descriptions that the driver keeps."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").limit(1)
    coded = docs.select(bpe.rank_literals(P.path("byte_bpe_50k.tiktoken")).alias("tables"))
    assert len(coded._jdf.queryExecution().toString()) < 100_000


def test_bpe_decodes_a_word_once(monkeypatch):
    """The word "ab " of ids 0, 1 and 2 a thousand times in each of two documents."""
    class Shared:
        def __init__(self, value):
            self.value = value

    taken, gather = [], bpe._gather
    monkeypatch.setattr(bpe, "_gather", lambda starts, sizes: taken.append(int(np.sum(sizes))) or gather(starts, sizes))
    sink = pa.BufferOutputStream()
    common = pa.table({"word": pa.array([], pa.large_string()), "ids": pa.array([], pa.list_(pa.int32()))})
    with pa.ipc.new_stream(sink, common.schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(["q"], pa.large_string()), pa.array([[3]], pa.list_(pa.int32()))], schema=common.schema))
    row = {"doc_ids": [5, 6], "anew": True, "sizes": np.array([1000, 1000], np.int64).tobytes(), "idx": bpe._CODEC.compress(np.zeros(2000, np.int32).tobytes(), asbytes=True), "shared": np.array([-1], np.int32).tobytes(), "codes": [[0, 1, 2]]}
    batch = pa.RecordBatch.from_pylist([row])
    (got,) = bpe._documents([batch], Shared(sink.getvalue().to_pybytes()), Shared([b"a", b"b", b" ", b"q"]), False)
    want = [hashlib.sha256(x).hexdigest() for x in (" ".join(["0 1 2"] * 1000).encode(), b"ab " * 1000)]
    assert [[r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] for r in got.to_pylist()] == [[i, 3000, *want] for i in (5, 6)]
    assert sum(taken) == 3


def test_simhash_matches_brute_force(docs, texts, empty):
    got = by_id(simhash.simhash_groups(docs))
    want = {i: brute_print(t) for i, t in texts.items()}
    assert {i: int(got[i]["fingerprint"], 16) for i in texts} == want
    roots = brute_components(list(texts), lambda a, b: bin(want[a] ^ want[b]).count("1") <= 3)
    assert {i: got[i]["component_id"] for i in texts} == roots
    assert simhash.simhash_groups(empty).count() == 0


def test_shingle_groups_match_brute_force(spark, docs, texts, empty, monkeypatch):
    rng = random.Random(21)
    many = dict(texts)
    for k in range(12):
        words = [f"{rng.choice(WORDS)}{rng.randrange(300)}" for _ in range(rng.choice([30, 120, 400]))]
        for j in range(5):
            changed = list(words)
            for _ in range(j * len(words) // 90):  # about Jaccard 1 to 0.65
                changed[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            many[100 + 10 * k + j] = " ".join(changed)

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))}

    sets = {i: grams(t) for i, t in many.items()}
    near = lambda a, b: sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    want = brute_components(list(many), near)
    unlike = [(a, b) for a in many for b in many if a < b and near(a, b) and sets[a] != sets[b]]
    prints = {i: brute_print(t, 5) for i, t in many.items()}
    assert sum(bin(prints[a] ^ prints[b]).count("1") > 3 for a, b in unlike) > 10  # pairs that radius 3 does not see
    df = spark.createDataFrame(list(many.items()), "doc_id long, text string").repartition(3)
    for hot in (64, 2):
        monkeypatch.setattr(shingles, "HOT", hot)
        assert {i: r["component_id"] for i, r in by_id(shingles.shingle_groups(df)).items()} == want
    assert shingles.shingle_groups(docs).count() == docs.count() and shingles.shingle_groups(empty).count() == 0


def test_shingle_groups_begin_with_simhash(spark, texts, monkeypatch):
    many = dict(texts) | {500: " ".join(f"w{i}" for i in range(4000)), 501: " ".join(f"w{i}" for i in range(3995))}
    asked = []
    pairs = shingles.print_pairs
    monkeypatch.setattr(shingles, "print_pairs", lambda prints: asked.append(pairs(prints)) or asked[-1])
    monkeypatch.setattr(shingles, "forget", lambda *tables: None)
    df = spark.createDataFrame(list(many.items()), "doc_id long, text string").repartition(3)
    got = by_id(shingles.shingle_groups(df))
    assert got[501]["component_id"] == 500 and len(asked) == 1
    assert brute_print(many[500], 5) == brute_print(many[501], 5) and asked[0].count() > 0
    prints = [(i, v) for i, v in enumerate([5, 4, 5 ^ 1 << 40, 0xFFFF00, 0xFFFF00, 1 << 60 | 0xFF0000])]
    found = {r["node"]: r["root"] for r in connected_components(pairs(spark.createDataFrame(prints, "id long, fp long"))).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_links_of_large_buckets(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(b) for b in base} | {int(base[i % 3]) ^ sum(1 << int(x) for x in rng.choice(64, 1 + i % 4, replace=False)) for i in range(150)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.near_links(df, 3, tile=16)
    found = {r["node"] % (1 << 64): r["root"] for r in connected_components(links).collect()}
    want = brute_components(sorted(fps), lambda a, b: bin(a ^ b).count("1") <= 3)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups(found) == [g for g in groups(want) if len(g) > 1]


def test_kernel_counts_every_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    a[1:80] = a[0] ^ (np.uint64(1) << np.arange(1, 80, dtype=np.uint64) % np.uint64(60)) ^ np.uint64(5)
    for radius in (1, 3, 7):
        lane, mask = simhash.within_radius(simhash.bit_planes(a), a, np.repeat(np.arange(130), 3), np.tile(np.arange(3), 130), radius)
        found = {(int(x) // 3, int(x) % 3 * 64 + b) for x, m in zip(lane, mask) for b in range(64) if int(m) >> b & 1}
        assert {(i, j) for i, j in found if j < 130} == {(i, j) for i in range(130) for j in range(130) if bin(int(a[i]) ^ int(a[j])).count("1") <= radius}


def test_mix_meets_targets(spark, docs, empty):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 5}") for i in range(400)] + [(400, None, None), (401, "one two", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, [5, 2, 1]).collect()
    again = mixing.mix(df.repartition(7), [5, 2, 1]).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again) and len(out) == len(rows)
    for s in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2
        assert mine[0]["source_size"] == sum(r["size"] for r in mine) and mine[0]["target"] <= 3 * mine[0]["source_size"] + 1e-9
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix(docs, [5, 2, 1]).count() == docs.count() and mixing.mix(empty, [1]).count() == 0


def test_targets_and_knapsack_against_brute_force():
    assert mixing.share_targets({"a": 10, "b": 100, "c": 100}, [5, 2, 1], 3) == {"a": 30, "b": 120.0, "c": 60.0}
    for _ in range(30):
        lengths = np.array(sorted(RNG.sample(range(1, 40), 5)))
        counts = np.array([RNG.randrange(0, 4) for _ in lengths])
        budget = RNG.randrange(0, 150)
        take = mixing.knapsack(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert (take <= counts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= budget)
    big = mixing.knapsack(np.arange(1, 300), np.full(299, 50), 1_234_567)
    assert int((big * np.arange(1, 300)).sum()) == 1_234_567


def test_knapsack_of_long_documents():
    fit = lambda lengths, counts, budget: (mixing.knapsack(np.array(lengths), np.array(counts), budget) * np.array(lengths)).sum()
    assert fit([70_000], [10], 350_000) == 350_000
    assert fit([90_000, 100_001], [3, 3], 280_000) == 270_000
    assert fit([200_000, *range(1, 200)], [1] * 200, 210_000) == 210_000
    lengths = np.arange(1, 2001)
    take = mixing.knapsack(lengths, np.ones(2000, np.int64), 1_000_500)
    assert (take * lengths).sum() == 1_000_500 and 350 < take[:1000].sum() < 650  # short and long ones alike
    many = mixing.knapsack(np.array([3, 900_000, 5_000_001]), np.array([10**7, 400, 300]), 10**9)
    assert int((many * np.array([3, 900_000, 5_000_001])).sum()) == 10**9 - 1 and (many <= [10**7, 400, 300]).all()


def test_flac_round_trip(docs, texts, empty):
    got = by_id(flac.store_texts(docs, keep_media=True))
    for i, t in texts.items():
        b = (t or "").encode()
        payload = b + bytes(max(-(-len(b) // 64) * 64, 64) - len(b))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        back, _ = flac.decode([bytes(r["media"])])
        assert back.tobytes() == payload and hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"]
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and flac.store_texts(empty).count() == 0


def test_flac_predictors_and_checksums():
    t = np.arange(9000)
    for wave in (np.zeros(9000), t % 200, 100 + 60 * np.sin(t / 40), np.random.default_rng(1).integers(0, 256, 9000)):
        data = wave.astype(np.uint8)
        stream = flac.encode(data, np.array([0, 9000]))[0]
        assert (flac.decode([stream])[0] == data).all()
        bad = bytearray(stream)
        bad[-30] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_shards_fit_and_cover(docs, empty):
    out = sharding.shard_documents(docs, 1500).collect()
    assert len(out) == docs.count()
    size = {}
    for r in out:
        key = (r["depth"], r["prefix"], r["page"])
        size.setdefault(key, []).append(r["n_bytes"])
    assert all(sum(v) <= 1500 or len(v) == 1 for v in size.values())
    assert sharding.shard_documents(empty, 1500).count() == 0


def test_shards_of_repeated_ids_overflow(spark):
    df = spark.createDataFrame([(1, "x" * 400)] * 10 + [(2, "y" * 5)], "doc_id long, text string")
    out = sharding.shard_documents(df, 1000).collect()
    pages = [r["page"] for r in out if r["doc_id"] == 1]
    assert len(out) == 11 and max(pages.count(p) for p in pages) <= 2


def test_chat_is_reversible(spark):
    rows = [(1, 0, "user", "a<|im_end|>\n<|im_start|>b"), (1, 1, "user", None), (1, 2, "assistant", "<\\|x|> <| <\\\\|"), (1, 3, "assistant", "second"), (2, 0, "odd\nrole\\n", "t"), (2, 0, "odd\nrole\\n", "t"), (3, None, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in (1, 2, 3, None):
        want = [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: r[1] or 0) if r[0] == c]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert back[c]["loss"] == [t for r, t in want if r == "assistant"]
    assert back[1]["formatted"].count("<|im_start|>") == 2 and back[1]["formatted"].count("<|im_end|>") == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_lines_keep_one_of_each_group(spark, docs, empty):
    near = " ".join(f"word{'abcdefghijklmnop'[i % 16]}{'qrstuvwxyz'[i // 16]}" for i in range(60))
    rows = [(2, "Same  LINE here, again!\nown line one two three four five\n--"), (1, "same line here again\n" + near), (3, near + ".\n--\nshort"), (4, "short"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = by_id(lines.dedup_lines(df))
    assert got[1]["text"] == rows[1][1] and got[2]["text"] == "own line one two three four five\n--"
    assert got[3]["text"] == "--\nshort" and got[4]["text"] == "" and got[4]["n_removed"] == 1 and got[5]["text"] is None and got[5]["n_lines"] == 0
    assert lines.dedup_lines(docs).count() == docs.count() and lines.dedup_lines(empty).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "alpha beta\nkeep one"), (2, "alpha beta\nunique second row"), (2, "quite another line\nother"), (None, "first of none\nalpha beta"), (None, "another of none\nfinal")]
    rows += [(7, "twice the same row"), (7, "twice the same row")]
    got = sorted((r["doc_id"] or 99, r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, "alpha beta\nkeep one"), (2, "unique second row"), (2, "quite another line\nother"), (99, "first of none"), (99, "another of none\nfinal")]
    assert got == sorted(want + [(7, "twice the same row")] * 2)


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(f"row {i} holds {i * 7919 % 10007} and {i * 104729 % 99991} words x{i}" for i in range(40_000))
    got = by_id(lines.dedup_lines(spark.createDataFrame([(1, "w " * 300_000 + "end"), (2, "row 5 holds 1\n" + "w " * 300_000 + "end"), (3, long)], "doc_id long, text string")))
    assert got[2]["text"] == "row 5 holds 1" and got[1]["n_removed"] == 0 and got[3]["n_lines"] == 40_000


def test_long_near_lines_are_found(spark):
    """Recall of pairs of long lines that are just similar enough, with words that occur nowhere else put in."""
    rng, rows = random.Random(33), []
    for i in range(150):
        n = rng.choice([20, 40, 80])
        base = [rng.choice("ouhe thand erin stha".split()) + str(rng.randrange(400)) for _ in range(n)]
        other = list(base)
        for at in rng.sample(range(n), n // 5):
            other[at] = f"new{i}x{at}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(got[2 * i + 1]["n_removed"] for i in range(150)) >= 0.9 * 150


def test_every_long_near_line_is_found(spark):
    """The rarest pairs of the changed lines are all new ones."""
    rng, rows = random.Random(34), []
    for i in range(80):
        n = rng.choice([20, 25, 40, 45, 80, 150])
        base = [rng.choice(WORDS[:4]) + rng.choice("abc") for _ in range(n)]
        other = list(base)
        for at in range(2, n, 5):
            other[at] = f"new{i}x{at}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [i for i in range(80) if not got[2 * i + 1]["n_removed"]] == [] and not any(got[2 * i]["n_removed"] for i in range(80))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def check_lines(spark, rng, lines_, near):
    """The lines that go, one line a document, equal those by brute force."""
    lines_ = sorted(set(lines_))
    rng.shuffle(lines_)
    root = brute_components(list(range(len(lines_))), lambda a, b: near(lines_[a], lines_[b]))
    df = spark.createDataFrame(list(enumerate(lines_)), "doc_id long, text string").repartition(3)
    got = by_id(lines.dedup_lines(df))
    assert {i for i in got if got[i]["n_removed"]} == {i for i, r in root.items() if r != i}
    assert any(r != i for i, r in root.items()) and any(r == i for i, r in root.items())


def changed(rng, items, times, new):
    items = list(items)
    for _ in range(times):
        at = rng.randrange(len(items))
        items[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [new()], [new()]])
    return items


@pytest.mark.parametrize("sizes, most", [((5, 6, 8, 12, 15), lines.WORD_PAIRS), ((5, 8, 12, 20, 33), 1 << 30)])
def test_near_lines_match_brute_force(spark, monkeypatch, sizes, most):
    monkeypatch.setattr(lines, "WORD_PAIRS", most)
    rng = random.Random(31)
    new = lambda: rng.choice(WORDS[:10]) + rng.choice("abcdefgh") * rng.randrange(3)
    out = [" ".join(["so"] * n) for n in (5, 6, 9)]
    for n in sizes:
        for _ in range(5):
            base = [new() for _ in range(n)]
            out += [" ".join(changed(rng, base, k, new)) for k in (0, n // 6 + 1, n // 5, n // 4)]
    out = [" ".join(x.lower().replace("'", " ").replace("-", " ").split()) for x in out]
    out = [x for x in out if len(x.split()) >= 5]
    check_lines(spark, rng, out, lambda a, b: edit_distance(a.split(), b.split()) <= max(len(a.split()), len(b.split())) * 0.2 + 1e-9)


def test_lines_of_few_words_match_brute_force(spark):
    rng = random.Random(32)
    out = ["a" * 47, "a" * 52]
    for n in (5, 8, 15, 24, 40, 47, 52, 90):
        for letters in ("abcdefghijklmnop", "天地玄黃宇宙洪荒日月盈昃辰宿列張"):
            base = [rng.choice(letters) for _ in range(n)]
            out += ["".join(changed(rng, base, k, lambda letters=letters: rng.choice(letters))) for k in (0, 1, n // 6, n // 5, n // 4)]
    out += ["Internationalisation considerations regarding documentation", "Internationalisation considerations regardng documentation"]
    out = [x.lower() for x in out if x]
    check_lines(spark, rng, out, lambda a, b: edit_distance(a, b) <= max(len(a), len(b)) * 0.2 + 1e-9)


def test_lines_of_one_passage_are_not_all_compared(spark, monkeypatch):
    """Lines that share most of a passage but are too far apart; two pairs of them are similar."""
    rng, seen, verified = random.Random(35), [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *more: seen.append(pairs.count()) or verified(pairs, *more))
    passage = [f"{rng.choice(WORDS[:6])}{i % 9}" for i in range(76)]
    rows = [(i, " ".join([*passage, *(f"own{i}x{j}" for j in range(24))])) for i in range(90)]
    rows += [(90 + i, rows[40 + i][1].replace(f"own{40 + i}x3", "other")) for i in range(2)]
    got = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [i for i in got if got[i]["n_removed"]] == [90, 91]
    assert sum(seen) < 600  # of 4186 pairs, all of which share keys


def test_lines_of_common_words_share_few_keys(spark, monkeypatch):
    """Most pairs of neighbouring words come in other lines too, few threes do; what is shuffled by key has no signatures."""
    from strandspark.llm import candidates

    rng, kept, saved = random.Random(36), [], candidates.save

    def save(df, name):
        out = saved(df, name)
        kept.extend([(out.columns, out.count())] if name == "lines-keys" else [])
        return out

    monkeypatch.setattr(candidates, "save", save)
    rows = [(i, " ".join(f"w{rng.randrange(150)}x" for _ in range(60))) for i in range(400)]
    rows += [(400 + i, rows[i][1].replace("1x", "2x", 9)) for i in range(3)]
    got = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [i for i in got if got[i]["n_removed"]] == [400, 401, 402]
    assert all("sign" not in columns for columns, _ in kept) and 0 < sum(n for _, n in kept) < 2500


def test_lines_shuffled_joins_agree(docs, monkeypatch):
    a = sorted(map(str, lines.dedup_lines(docs).collect()))
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    assert sorted(map(str, lines.dedup_lines(docs).collect())) == a


def test_fertility_base_rules(docs, texts, empty):
    got = by_id(fertility.fertility_rules(docs, P.path("piece_bpe_32k.model")))
    for i, t in texts.items():
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        twice = {g for g in grams if grams.count(g) > 1}
        cover = {k + j for k, g in enumerate(grams) if g in twice for j in range(8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)), i
        assert r["base_failed"] == (len(words) < 20 or 100 * len(cover) > 30 * len(words)) and not (r["kept"] and r["base_failed"])
    assert got[3]["kept"] and fertility.fertility_rules(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_fertility_bands_reject_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = fertility.fertility_rules(docs, P.path("piece_bpe_32k.model")).where("not base_failed").join(labels.select("doc_id", "quality"), "doc_id")
    kept = {r["quality"]: (r["n"], r["k"]) for r in got.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[0][0] >= 20 and kept[0][1] <= 0.2 * kept[0][0], kept
    assert kept[1][1] >= 0.97 * kept[1][0], kept
    clean = docs.join(labels.where("quality = 1"), "doc_id").where("lang = 'en' and n_chars > 1500").orderBy("doc_id").first()["text"]
    words = clean.split()
    junk = {1: clean, 2: " ".join(w + "***" for w in words), 3: " | ".join(words), 4: " ".join(f"{w}{'$#%&'[i % 4] * 3}" for i, w in enumerate(words))}
    df = spark.createDataFrame(list(junk.items()), "doc_id long, text string")  # without a column lang
    assert {i: r["kept"] for i, r in by_id(fertility.fertility_rules(df, P.path("piece_bpe_32k.model"))).items()} == {1: True, 2: False, 3: False, 4: False}


def test_attention_learns_and_scores_all(spark, docs, empty):
    rows, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        body = [prose(150) for _ in range(3)]
        if bad:
            body[i % 2] = " ".join(w + RNG.choice(["***", "$$$", "%%%"]) for w in prose(150).split())
        rows.append((i, " ".join(body)))
        marks.append((i, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = attention.train(df, spark.createDataFrame(marks, "doc_id long, quality int"), rows=250)
    got = by_id(attention.score_documents(df, model))
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i]["predicted"] == 1) == (i % 3 > 0) for i in held) >= 0.95 * len(held)
    out = attention.score_documents(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert attention.score_documents(empty, model).count() == 0
    untaught = attention.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert attention.score_documents(df, untaught).where("predicted = 0").count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, many, y = rng.normal(size=(6, attention.WIDTH)), np.array([2, 3, 1]), np.array([1.0, 0.0, 1.0])
    model = attention.fit(x, many, y, rounds=30)
    score, parts = attention.forward(model, x, many)
    assert ((score > 0.5) == (y > 0)).all() and np.allclose(np.add.reduceat(parts["a"], parts["start"]), 1)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(9, 9)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    link = set(map(frozenset, edges))
    want = brute_components(sorted({x for e in edges for x in e}), lambda a, b: frozenset((a, b)) in link)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}


def test_saved_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in found.mkString("\n").split("\n") if "shuffle_" in f}

    rows = spark.range(1000).select("id", F.col("id").alias("v")).repartition(3, "id")
    for write in (lambda: common.save(rows, "dropped"), lambda: common.save_bucketed(rows.groupBy("v").count(), "dropped-buckets", "v")):
        was = files()
        saved = write()
        ends = time.time() + 5
        while files() - was and time.time() < ends:
            time.sleep(0.1)
        assert not files() - was and saved.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
