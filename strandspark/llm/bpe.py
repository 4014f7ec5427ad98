"""Byte-level BPE: ranked merges folded by Spark higher-order functions over the bytes of distinct words.

Each task gathers its documents into chunks of bounded size. A chunk row holds the words (the matches of the split
pattern) that the task has not met before, and every document as numbers of words. Spark expressions fold the merges over
each new word against a literal rank map; the chunk is then read back into documents by the same task, which remembers the
ids of its words, decodes them once by concatenating binary pieces, and joins what words decode to. Words that are common in a sample are folded once and
broadcast, which saves work and changes no result. Documents are not shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import byte_blocks, forget, give_back, save, shuffle_partitions, small_batches, text_bytes

#: Bits of an id, and the rank of a pair that does not merge. Both ends of a word are marked by the id after the last, which
#: merges with none.
ID_BITS, NONE = 17, 2**17 - 1
#: Bits of an id and of the byte that it begins at (words of up to half a gigabyte); a pair's rank stands above them.
PLACE_BITS = ID_BITS + 29
#: Text bytes of a chunk (one longer document makes a chunk of its own), and words that a task remembers before it begins anew.
CHUNK_BYTES, TASK_WORDS = 2 << 20, 1 << 18
#: Words that are folded once for all tasks, and about how many bytes of text they are looked for in.
COMMON_WORDS, SAMPLE_BYTES = 1 << 18, 64 << 20
#: White space other than single blanks or line feeds between words: such texts are split by the pattern itself.
ODD_SPACE = ("  ", " \n", "\n ", "\n\n", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


_CODEC = pa.Codec("lz4")


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 piece and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def _pair_table(path: str) -> tuple[list[int], list[int]]:
    """The rank map of neighbouring ids as a row-displaced table: (base by left id, entries).

    If the pieces of `left` and `right` join to a piece, its entry ``left * 2**ID_BITS + joined`` is at base[left] + right;
    any other place that a pair points to holds another left id or -1. The end mark has no entry.
    """
    ranks = read_ranks(path)
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    width = max(ranks.values()) + 2  # ids and the end mark
    base, free, low = [0] * width, np.ones(1 << 22, bool), 0
    entries = np.full(1 << 22, -1, np.int64)
    for left, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        rights = np.array(sorted(row))
        first, step = max(low, int(rights[0])), 4096
        while True:
            starts = first + np.flatnonzero(free[first : first + step]) - rights[0]
            fits = starts[starts >= 0]
            for r in rights[1:]:
                fits = fits[free[fits + r]]
            if len(fits):
                break
            first += step
        base[left] = int(fits[0])
        free[fits[0] + rights] = False
        entries[fits[0] + rights] = [left << ID_BITS | row[r] for r in rights.tolist()]
        while not free[low]:
            low += 1
    return base, entries[: int(np.flatnonzero(entries >= 0)[-1]) + width + 1].tolist()


def rank_literals(path: str) -> Column:
    """The rank map of neighbouring ids as a struct of literals that Catalyst folds once: (base, pairs)."""
    base, pairs = _pair_table(path)
    parsed = lambda value, kind: F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)
    return F.struct(parsed(base, "array<int>").alias("base"), parsed(pairs, "array<bigint>").alias("pairs"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: the end of an aggregation over nothing that begins with the value. (As the
    element of a transformed array, each result would be copied, and its type derived anew, whenever it is evaluated.)"""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, body)


def _joined(tables: Column, left: Column, right: Column) -> Column:
    """The id that two neighbouring ids merge to, or NONE."""
    entry = F.get(tables["pairs"], F.get(tables["base"], left) + right)
    return F.when(F.shiftright(entry, ID_BITS) == left, entry.bitwiseAND(F.lit(NONE)).cast("int")).otherwise(F.lit(NONE))


def fold_merges(tables: Column, word: Column) -> Column:
    """The ids of one word, given its bytes' ids between two end marks: while a neighbouring pair can merge, the first pair
    of the lowest rank becomes one id (a merged id is its pair's rank).

    The state is one array of longs: the rank of the pair that begins with an id, the byte that the id begins at, and the
    id. The least one is thus the first pair of the lowest rank, and a merge changes no other byte position.
    """
    part = lambda e: e.bitwiseAND(F.lit(NONE)).cast("int")
    ranked = lambda rank, place: F.shiftleft(rank.cast("long"), PLACE_BITS).bitwiseOR(place)
    begin = lambda i: F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(F.get(word, i))
    start = F.transform(F.sequence(F.lit(0), F.size(word) - 2), lambda i: ranked(_joined(tables, F.get(word, i), F.get(word, i + 1)), begin(i)))

    def merge(pairs: Column, least: Column, at: Column) -> Column:
        low, before = F.shiftright(least, PLACE_BITS).cast("int"), F.get(pairs, at - 2)
        after = F.coalesce(part(F.get(pairs, at + 1)), F.get(word, F.lit(0)))  # the end mark at last
        left = ranked(_joined(tables, part(before), low), before.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
        place = least.bitwiseAND(F.lit((1 << PLACE_BITS) - (1 << ID_BITS))).bitwiseOR(low)
        return F.concat(F.slice(pairs, F.lit(1), at - 2), F.array(left, ranked(_joined(tables, low, after), place)), F.slice(pairs, at + 2, F.size(pairs)))

    def step(pairs: Column, _: Column) -> Column:
        found = _let(F.array_min(pairs), lambda least: _let(F.array_position(pairs, least).cast("int"), lambda at: merge(pairs, least, at)))
        return F.when(F.array_min(pairs) >= F.lit(NONE << PLACE_BITS), pairs).otherwise(found)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word) - 3, F.lit(1))), start, step)
    return _let(folded, lambda pairs: F.transform(F.slice(pairs, F.lit(2), F.size(pairs) - 1), part))


class Words:
    """The words that a task has met, numbered as they come."""

    def __init__(self, pattern: str):
        self.pattern, self.find = pattern, regex.compile(pattern)
        self.begin()

    def begin(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.fresh: list[pa.Array] = []
        # parts of texts between blanks: the numbers of part i's words are flat[start[i] : start[i] + size[i]]
        self.parts = pa.array([], pa.large_string())
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The words' numbers; new ones join `fresh`."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        number, new = _look(coded.dictionary, self.words)
        if len(new):
            self.words = pa.concat_arrays([self.words, new])
            self.fresh.append(new)
        return number[coded.indices.to_numpy(zero_copy_only=False)]

    def split(self, texts: list[str]) -> list[np.ndarray]:
        """The word numbers of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        # the cuts below are those of the public pattern; texts of another one are split by the pattern itself
        odd = [i for i, t in enumerate(texts) if t and (self.pattern != public_tokenizers.PATTERN or t[0] in " \n" or t[-1] in " \n" or any(x in t for x in ODD_SPACE))]
        at = set(odd)
        plain = [i for i, t in enumerate(texts) if t and i not in at]
        if odd:
            found = [self.find.findall(texts[i]) for i in odd]
            cut = np.cumsum([0, *map(len, found)])
            numbers = self.numbers([p for pieces in found for p in pieces])
            for i, a, b in zip(odd, cut[:-1], cut[1:], strict=True):
                out[i] = numbers[a:b]
        if plain:
            # a cut before a blank or line feed that stands alone between words is a cut of the pattern too
            marked = pc.replace_substring(pa.array(["\n" + texts[i] for i in plain], pa.large_string()), "\n", " \n")
            lists = pc.split_pattern(marked, " ")
            ends = lists.offsets.to_numpy()
            coded = lists.flatten().dictionary_encode()
            part = self._known_parts(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            sizes = self.size[part]
            numbers = self.flat[_gather(self.start[part], sizes)]
            cut = np.r_[0, np.cumsum(sizes)][ends]
            for i, a, b in zip(plain, cut[:-1], cut[1:], strict=True):
                out[i] = numbers[a + 1 : b]  # without the line feed put before the text
        return out

    def _known_parts(self, parts: pa.Array) -> np.ndarray:
        number, new = _look(parts, self.parts)
        if len(new):
            # letters alone are one match
            found = [[" " + p] if p.isalpha() else self.find.findall(p if p[:1] in ("", "\n") else " " + p) for p in new.to_pylist()]
            size = np.array([len(x) for x in found], np.int64)
            flat = self.numbers([p for pieces in found for p in pieces])
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
            self.size = np.r_[self.size, size]
            self.flat = np.r_[self.flat, flat]
            self.parts = pa.concat_arrays([self.parts, new])
        return number


def _look(values: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each of the distinct values in `known` followed by the new ones, and these."""
    at = pc.index_in(values, value_set=known)
    new = at.is_null()
    number = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
    mask = new.to_numpy(zero_copy_only=False)
    number[mask] = len(known) + np.arange(int(mask.sum()))
    return number, values.filter(new)


def _joined_batches(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about `limit` bytes of text."""
    held, size = [], 0
    for batch, data, _ in byte_blocks(batches, limit):
        if held and size + len(data) > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += len(data)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _parts(words: pa.Array, byte_ids: list[int]) -> pa.ListArray:
    """The bytes' ids of each word between two end marks."""
    raw = words.cast(pa.large_binary())
    data, at = text_bytes(raw)
    ends = at + 2 * np.arange(len(at))
    parts = np.full(int(ends[-1]), byte_ids[-1], np.int32)
    inner = np.ones(len(parts), bool)
    inner[ends[:-1]] = inner[ends[1:] - 1] = False
    parts[inner] = np.array(byte_ids[:256], np.int32)[data]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(parts))


@lru_cache(maxsize=2)
def _read(shared: Broadcast) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The common words, and the offsets and ids of their codes."""
    table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
    return table.column("word").chunk(0), *_lists(table.column("ids").chunk(0))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int32)


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + sizes[i], one after the other."""
    until = np.cumsum(sizes)
    out = np.arange(int(until[-1]) if len(until) else 0)
    out += np.repeat(starts - until + sizes, sizes)
    return out


def _chunks(batches: Iterable[pa.RecordBatch], pattern: str, common: Broadcast, byte_ids: list[int], limit: int, task_words: int) -> Iterator[pa.RecordBatch]:
    shared = _read(common)[0]
    state, anew = Words(pattern), True
    for batch in _joined_batches(batches, limit):
        if len(state.words) > task_words:
            state.begin()
            anew = True
        state.fresh = []
        numbers = state.split(_texts(batch))
        fresh = pa.concat_arrays(state.fresh) if state.fresh else pa.array([], pa.large_string())
        at = pc.index_in(fresh, value_set=shared)
        parts = _parts(fresh.filter(at.is_null()), byte_ids)
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        sizes = np.array([len(x) for x in numbers], np.int64)
        made = [
            pa.array([batch.column("doc_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
            pa.array([anew]),
            pa.array([sizes.tobytes()], pa.binary()),
            pa.array([_CODEC.compress(flat.tobytes(), asbytes=True)], pa.binary()),
            pa.array([at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32).tobytes()], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts),
        ]
        anew = False
        del numbers, flat, fresh, parts, at
        yield pa.RecordBatch.from_arrays(made, ["doc_ids", "anew", "sizes", "idx", "shared", "words"])
    del state
    give_back()


def _documents(batches: Iterable[pa.RecordBatch], common: Broadcast, pieces: Broadcast, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    _, at_shared, ids_shared = _read(common)
    piece = pa.array(pieces.value, pa.large_binary())
    spelling = pa.array([f"{i} " for i in range(len(piece))], pa.large_string())
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    start, size, ids = none  # of the codes of the task's words
    lines = raws = pa.array([], pa.large_binary())  # the words' decimal ids, a blank after each, and the bytes that these decode to
    for batch in batches:
        for row in range(batch.num_rows):
            cell = lambda name: batch.column(name)[row]  # noqa: B023, E731
            if cell("anew").as_py():
                start, size, ids = none
                lines = raws = pa.array([], pa.large_binary())
            at = np.frombuffer(cell("shared").as_py(), np.int32)
            own, codes = _lists(cell("codes").values) if len(cell("codes")) else (np.zeros(1, np.int64), np.zeros(0, np.int32))
            both = np.r_[at_shared, len(ids_shared) + own[1:]]
            word = np.where(at < 0, np.cumsum(at < 0) - 1 + len(at_shared) - 1, at)
            many = both[word + 1] - both[word]
            found = np.r_[ids_shared, codes][_gather(both[word], many)]
            lines, raws = pa.concat_arrays([lines, _by_word(spelling, found, many)]), pa.concat_arrays([raws, _by_word(piece, found, many)])
            size = np.r_[size, many]
            if keep_ids:
                start, ids = np.r_[start, len(ids) + np.cumsum(many) - many], np.r_[ids, found]
            cut = np.r_[0, np.cumsum(np.frombuffer(cell("sizes").as_py(), np.int64))]
            index = np.frombuffer(_CODEC.decompress(cell("idx").as_py(), int(4 * cut[-1]), asbytes=True), np.int32)
            counts = size[index]
            until = np.r_[0, np.cumsum(counts)][cut]
            taken = pa.array(index)
            (line, line_at), (raw, raw_at) = _bytes(lines.take(taken)), _bytes(raws.take(taken))
            line_at, raw_at = line_at[cut], raw_at[cut]
            ids_sha, text_sha = [], []
            for a, b in zip(line_at[:-1].tolist(), line_at[1:].tolist(), strict=True):
                ids_sha.append(hashlib.sha256(line[a : max(a, b - 1)]).hexdigest())  # without the last blank
            for a, b in zip(raw_at[:-1].tolist(), raw_at[1:].tolist(), strict=True):
                text_sha.append(hashlib.sha256(raw[a:b]).hexdigest())
            out = [pa.array(cell("doc_ids").as_py(), pa.int64()), pa.array(np.diff(until)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out, names = [*out, pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(ids[_gather(start[index], counts)]))], [*names, "ids"]
            del index, counts, taken, line, raw, line_at, raw_at
            yield pa.RecordBatch.from_arrays(out, names)
    start = size = ids = none
    del lines, raws
    give_back()


def _by_word(strings: pa.Array, ids: np.ndarray, many: np.ndarray) -> pa.Array:
    """The strings of the ids, `many` of them joined for each word."""
    data, at = _bytes(strings.take(pa.array(ids)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(at[np.r_[0, np.cumsum(many)]]), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All bytes of a large string or binary column, and its offsets."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return memoryview(column.buffers()[2] or b""), offsets


def _sampled_words(batches: Iterable[pa.RecordBatch], pattern: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (word, n): the words of each block of documents."""
    state = Words(pattern)
    for batch in _joined_batches(batches, limit):
        state.begin()
        many = np.bincount(np.concatenate([np.zeros(0, np.int32), *state.split(_texts(batch))]), minlength=len(state.words))
        yield pa.RecordBatch.from_arrays([state.words.cast(pa.string()), pa.array(many)], ["word", "n"])
    del state
    give_back()


def _common(source: DataFrame, tables: Column, ranks: dict[bytes, int], pattern: str, byte_ids: list[int], limit: int) -> Broadcast:
    """Words with their ids: all that are pieces as they stand, and of the others at most COMMON_WORDS, those most often met
    in a sample of about SAMPLE_BYTES of text."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = source.where(F.pmod(F.xxhash64("text"), F.lit(max(1, round(size / SAMPLE_BYTES)))) == 0)
    counted = sample.mapInArrow(partial(_sampled_words, pattern=pattern, limit=limit), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # written first: a plan with the rank map's literal is then never planned anew on the way
    often = save(counted.where("n > 1").orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word").repartition(shuffle_partitions(source.sparkSession)), "bpe-words")
    spelt = often.mapInArrow(partial(_spelt, byte_ids=byte_ids), "word string, parts array<int>")
    coded = spelt.select("word", _let(tables, lambda t: fold_merges(t, F.col("parts"))).alias("ids")).toArrow()
    forget(often)
    whole = {}
    for piece, rank in ranks.items():
        try:
            whole[piece.decode()] = rank
        except UnicodeDecodeError:
            pass
    words = pa.array(whole, pa.large_string())
    ids = pa.array([[rank] for rank in whole.values()], pa.list_(pa.int32()))
    if coded.num_rows:
        coded = coded.combine_chunks()
        new = pc.invert(pc.is_in(coded.column("word").chunk(0).cast(pa.large_string()), value_set=words))
        words = pa.concat_arrays([words, coded.column("word").chunk(0).cast(pa.large_string()).filter(new)])
        ids = pa.concat_arrays([ids, coded.column("ids").chunk(0).cast(ids.type).filter(new)])
    sink = pa.BufferOutputStream()
    table = pa.table({"word": words, "ids": ids})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    shared = source.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    del coded, whole, words, ids, table, sink
    give_back()
    return shared


def _spelt(batches: Iterable[pa.RecordBatch], byte_ids: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("word"), _parts(batch.column("word"), byte_ids)], ["word", "parts"])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, chunk_bytes: int = CHUNK_BYTES, task_words: int = TASK_WORDS) -> DataFrame:
    """Encode every text by the ranks in a tiktoken file, each match of `pattern` separately, and decode the ids again.

    Returns one row per input row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 (of the decoded bytes) and, if asked for, the ids. Null and empty texts have no tokens; repeated
    rows, rows that share a doc_id and rows without one stay; an empty table gives no rows; extra columns are ignored.
    Special tokens' strings are ordinary text. No text is cut: one longer than a chunk makes a chunk of its own.
    """
    small_batches(docs.sparkSession)
    ranks = read_ranks(ranks_path)
    byte_ids = [*(ranks[bytes([b])] for b in range(256)), max(ranks.values()) + 1]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tables = rank_literals(ranks_path)
    common = _common(source, tables, ranks, pattern, byte_ids, chunk_bytes)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    pieces = docs.sparkSession.sparkContext.broadcast(pieces)
    read = partial(_chunks, pattern=pattern, common=common, byte_ids=byte_ids, limit=chunk_bytes, task_words=task_words)
    chunks = source.mapInArrow(read, "doc_ids array<long>, anew boolean, sizes binary, idx binary, shared binary, words array<array<int>>")
    codes = _let(tables, lambda t: F.transform("words", lambda word: fold_merges(t, word)))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return chunks.select("doc_ids", "anew", "sizes", "idx", "shared", codes.alias("codes")).mapInArrow(partial(_documents, common=common, pieces=pieces, keep_ids=keep_ids), schema)
