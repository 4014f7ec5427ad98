"""Quality rules by tokeniser fertility: how well a public vocabulary spells a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Scripts told apart by the first code point of the block that most letters of a text fall in.
SCRIPTS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x3040, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))
#: Accepted bands by script: characters per token (low, high), most share of byte-fallback tokens, least entropy of the
#: tokens in bits divided by the most that their number allows, and from how many tokens on entropy counts. The corpus has
#: no text of these scripts to measure them on.
BANDS = {
    "greek": (0.8, 6.0, 0.35, 0.45, 50),
    "cyrillic": (1.2, 8.0, 0.20, 0.45, 50),
    "han": (0.4, 3.0, 0.75, 0.45, 50),
    "kana": (0.4, 4.0, 0.60, 0.45, 50),
    "hangul": (0.35, 3.0, 0.80, 0.45, 50),
    "none": (0.3, 12.0, 1.0, 0.45, 50),
}
_OTHER = (0.25, 9.0, 0.95, 0.45, 50)
#: Bands of Latin script by language, from the clean labelled documents of sf0.1. Characters per token: median, and how far
#: below and above it a text of n tokens may lie, times the root of n (0.2 and 99.8 % quantiles); share of tokens without a
#: letter or digit: median, and how far above, likewise; least entropy, as above (0.2 % quantile). Text of any other
#: language must fit one of them. Byte fallback does not occur in those documents.
LATIN = {
    "en": (2.219, 4.6, 2.7, 0.068, 0.79, 0.577),
    "de": (2.243, 3.2, 2.6, 0.063, 0.75, 0.560),
    "es": (1.940, 2.8, 2.7, 0.086, 0.72, 0.564),
    "fr": (1.979, 4.3, 2.5, 0.070, 0.59, 0.551),
}
LATIN_FALLBACK, LATIN_ENOUGH = 0.01, 50
#: Distinct words whose ids a task remembers at once.
MEMO = 400_000


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _fallback(path: str) -> np.ndarray:
    model = _model(path)
    return np.array([model.is_byte(i) or model.is_unknown(i) for i in range(model.get_piece_size())])


@lru_cache(maxsize=2)
def _letterless(path: str) -> np.ndarray:
    model, fallback = _model(path), _fallback(path)
    return np.array([not fallback[i] and not any(map(str.isalnum, model.id_to_piece(i))) for i in range(model.get_piece_size())])


def repeated_words(words: np.ndarray, width: int = 8) -> int:
    """Words in `width`-word windows that occur twice or more; `words` holds a number for each word of a text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    mixed = (words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    for k in range(width):
        h = (h ^ mixed[k : k + n]) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def script_of(text: str) -> str:
    """The script of most letters; "none" without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = points[((points >= 0x41) & (points <= 0x5A)) | ((points >= 0x61) & (points <= 0x7A)) | (points >= 0xC0)]
    if not len(letters):
        return "none"
    block = np.searchsorted([s[0] for s in SCRIPTS], letters, "right") - 1
    return SCRIPTS[int(np.bincount(block, minlength=len(SCRIPTS)).argmax())][1]


def fits_latin(lang: str | None, n_tokens: int, per: float, fallback: float, evenness: float, blank: float) -> bool:
    """Whether a text in Latin script lies in the bands of its language, or in any if LATIN does not have it."""
    if not n_tokens or fallback > LATIN_FALLBACK:
        return False
    root = n_tokens**0.5
    for mid, below, above, usual, more, least in [LATIN[lang]] if lang in LATIN else LATIN.values():
        if -below <= (per - mid) * root <= above and (blank - usual) * root <= more and (n_tokens < LATIN_ENOUGH or evenness >= least):
            return True
    return False


def _measure(batches: Iterable[pa.RecordBatch], model_path: str, bands: dict) -> Iterator[pa.RecordBatch]:
    model, fallback, letterless = _model(model_path), _fallback(model_path), _letterless(model_path)
    memo: dict[bytes, int] = {}  # word -> its number
    numbers: list[np.ndarray] = []  # ids of the words by number
    counts: list[int] = []
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "n_tokens", "chars_per_token", "fallback_share", "entropy", "letterless_share")
    for batch in batches:
        out: dict[str, list] = {name: [] for name in names}
        for doc_id, value, lang in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            text = value.as_py() or ""
            raw = text.encode()
            words = raw.split()  # at bytes 0x20 and 0x09-0x0D
            n_words = len(words)
            if len(memo) + n_words > MEMO and memo:
                memo, numbers, counts = {}, [], []
            new = [w for w in dict.fromkeys(words) if w not in memo]
            if new:
                for w, ids in zip(new, model.encode([w.decode() for w in new], num_threads=1), strict=True):
                    memo[w] = len(numbers)
                    numbers.append(np.array(ids, np.int32))
                    counts.append(len(ids))
            index = np.array([memo[w] for w in words], np.int64)
            chars = len(text) - sum(raw.count(b) for b in b" \t\n\r\x0b\x0c")
            seen: set[bytes] = set()
            dup = 0
            for line in raw.split(b"\n"):
                if line in seen:
                    dup += 1
                elif line and not line.isspace():
                    seen.add(line)
            again = repeated_words(index)
            ids = np.concatenate([numbers[i] for i in index.tolist()]) if n_words else np.zeros(0, np.int32)
            n_tokens = len(ids)
            per = chars / n_tokens if n_tokens else 0.0
            share = float(fallback[ids].mean()) if n_tokens else 0.0
            blank = float(letterless[ids].mean()) if n_tokens else 0.0
            entropy = 0.0
            if n_tokens > 1:
                p = np.bincount(ids)
                p = p[p > 0] / n_tokens
                entropy = float(-(p * np.log2(p)).sum())
            failed = n_words < 20 or 100 * again > 30 * n_words
            script = script_of(text)
            even = np.log2(min(max(n_tokens, 2), 4096))
            if script == "latin" and script not in bands:
                fits = fits_latin(lang, n_tokens, per, share, entropy / even, blank)
            else:
                low, high, most, least, enough = bands.get(script, _OTHER)
                fits = low <= per <= high and share <= most and (n_tokens < enough or entropy >= least * even)
            row = (doc_id, n_words, chars, sum(raw.count(b) for b in SYMBOLS), dup, again, failed, not failed and bool(fits), script, n_tokens, per, share, entropy, blank)
            for name, x in zip(names, row, strict=True):
                out[name].append(x)
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict(out | {"doc_id": pa.array(out["doc_id"], pa.int64())})


def fertility_rules(docs: DataFrame, model_path: str, bands: dict | None = None) -> DataFrame:
    """Judge every whole text by base rules and by how a public sentencepiece vocabulary spells it.

    Words are runs of anything but ASCII white space; each is spelt on its own, as the vocabulary never joins words.
    Returns one row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (fewer than 20 words, or over 30 % of them in repeated 8-word windows), kept, and the measures behind it: script,
    n_tokens, chars_per_token, fallback_share, entropy (bits) and letterless_share (tokens without a letter or digit), which
    must lie in the bands of the text's script, or of its language (column `lang`, optional) if the script is Latin.
    Null and empty texts have no words and fail; repeated rows stay; an empty table gives no rows; extra columns are
    ignored. Memory is bounded by the longest text and MEMO words.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, fallback_share double, entropy double, letterless_share double"
    return source.mapInArrow(partial(_measure, model_path=model_path, bands=bands or BANDS), schema)
