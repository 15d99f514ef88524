"""Language identification by bit-sliced Bloom filters over character n-grams.

Each slot of the filter holds one bit a language, so a single look-up returns every language that contains an n-gram:
the AND of its slots. A language contains an n-gram if it makes up a share of the n-grams learned from that language and
a share of that n-gram's rate over all languages. For a text, the n-grams found are counted per language (popcounts of
the bit slices), corrected for the false positives that the fill of each slice implies, and the largest count decides.

Learning takes a documented number of documents per language, picked by a hash of the id, and whole texts of these.

Defined cases: null text, or text without a letter, is `und` with score 0; so is every text where nothing was learned.
Without any hit, or on ties, the language with more learned documents, then the smaller name, wins. Null languages are
not learned from. Repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow import map_rows

SIZES = (3, 4)
#: Expected number of learned documents per language.
DOCS_PER_LANGUAGE = 1500
#: Least share of a language's n-grams; so a language contains 1 / LEAST_SHARE n-grams at most.
LEAST_SHARE = 1e-5
#: Least share of an n-gram's rate over all languages.
LEAST_PART = 0.2
SLOTS, HASHES = 1 << 21, 3
UNKNOWN = "und"
#: Code points of a text that are hashed at once, and n-grams that a task holds before it counts them.
PIECE, HELD = 1 << 18, 2_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of the lower-cased words, each word with a space before and after it."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    codes, letter = codes[kept], letter[kept]
    codes = np.concatenate(([np.uint32(32)], codes, [np.uint32(32)])).astype(np.uint64)
    inner = np.concatenate(([False], letter, [False]))
    out = []
    for n in SIZES:
        if (count := len(codes) - n + 1) <= 0:
            continue
        key, good = np.full(count, n, np.uint64), np.ones(count, bool)
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + count]
            if 0 < k < n - 1:
                good &= inner[k : k + count]
        out.append(_mixed(key[good]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_SPACE = re.compile(r"\s")


def pieces(text: str) -> Iterator[str]:
    """The text in parts that end at white space, so that no word is cut; a text without any is one part."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at + 1, at + PIECE) for c in " \n\t")
        if cut < 0:
            cut = found.start() if (found := _SPACE.search(text, at + 1)) else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def slots(keys: np.ndarray) -> list[np.ndarray]:
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return [((keys + np.uint64(k) * step) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    """languages in order of learned documents; masks: [slot, word of 64 languages]; false: of each language's slice."""

    languages: list[str]
    masks: np.ndarray
    false: np.ndarray

    @classmethod
    def learn(cls, languages: list[str], held: dict[str, np.ndarray]) -> Model:
        masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
        false = np.zeros(len(languages))
        for k, lang in enumerate(languages):
            filled = np.zeros(SLOTS, bool)
            for at in slots(held.get(lang, np.zeros(0, np.uint64))):
                filled[at] = True
            masks[filled, k // 64] |= np.uint64(1) << np.uint64(k % 64)
            false[k] = filled.mean() ** HASHES
        return cls(languages, masks, false)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        total, looked = np.zeros(len(self.languages)), 0
        for piece in pieces(text):
            keys = grams(piece)
            looked += len(keys)
            found = None
            for where in slots(keys):
                found = self.masks[where] if found is None else found & self.masks[where]
            for k in range(len(self.languages)):
                total[k] += np.count_nonzero(found[:, k // 64] >> np.uint64(k % 64) & np.uint64(1))
        return total, looked

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, looked = self.counts(text)
        right = np.maximum(0, (total - looked * self.false) / np.maximum(1e-9, 1 - self.false))
        best = int(right.argmax())
        return self.languages[best], float(right[best] / right.sum()) if right.sum() else 0.0


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Fits the filters on docs. Two jobs: documents per language, then n-gram counts, summed per task before the shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    number = {lang: k for k, lang in enumerate(languages)}
    if not languages:
        return Model.learn([], {})
    rate = F.element_at(F.create_map(*(F.lit(v) for lang in languages for v in (lang, min(1.0, docs_per_language / sizes[lang])))), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit("language")), F.lit(1 << 20)) < rate * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        held = 0

        def counts() -> Iterator[pa.RecordBatch]:
            for lang, parts in found.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), lang, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in pieces(text.as_py()):
                    own = grams(piece)
                    found.setdefault(number[lang], []).append(own)
                    held += len(own)
                    if held >= HELD:
                        yield from counts()
                        found, held = {}, 0
        yield from counts()

    counted = picked.select("lang", "text").mapInArrow(count, "lang int, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Model.learn(languages, {})
    rates = counted.withColumn("rate", F.col("n") / F.element_at(F.create_map(*(F.lit(v) for x in totals.items() for v in (x[0], float(x[1])))), F.col("lang")))
    by_gram = rates.groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("of"), F.sum("rate").alias("all"))
    kept = by_gram.select("gram", F.explode("of").alias("of"), "all").where((F.col("of.rate") >= LEAST_SHARE) & (F.col("of.rate") >= LEAST_PART * F.col("all"))).select(F.col("of.lang").alias("lang"), "gram")
    table = kept.toArrow()
    langs, keys = table.column("lang").to_numpy(), table.column("gram").to_numpy().view(np.uint64)
    return Model.learn(languages, {lang: keys[langs == k] for lang, k in number.items()})


def identify(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns[0], lang_pred and score of each text. The filter, of a size fixed by SLOTS, is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return own.predict

    return map_rows(docs, [*columns, text_col], [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())], make)
