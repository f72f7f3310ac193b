"""Language identification with hyperdimensional profiles.

Each of 64 letter symbols has a random vector of +1 and -1. A trigram is bound as the product of its
letters' vectors, permuted twice, once and not at all; a text or a language is the bundle (sum) of its
trigrams; a document takes the language whose prototype has the largest cosine with it.

Bundling is linear, so a language's prototype comes from its trigram counts, and a document's inner
products are sums over its trigrams of each trigram's product with the prototypes. The document's own
norm is the same for all languages and cancels, in the choice and in ``score``: the chosen cosine as a share of
all positive cosines, 0 where none is positive.

Edge cases: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Ties
go to the language first in order. A null id is predicted but not learned from. Very long texts count whole, two
million characters at a time. Repeated rows are
learned from and predicted each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chosen, learned, only, slices, texts_of, trimmed

SYMBOLS = 64
DIMENSIONS = 2048
CODES = SYMBOLS**3
CHARS = 1 << 21  # more than a slice has unless it is one long text, so sums don't hang on where slices end

_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Symbol by code point: 0 if no letter, a-z as 1-26, other letters dealt over the rest."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = ord(chr(c).lower()[0])
                table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
        _TABLE.append(table)
    return _TABLE[0]


def trigrams(texts: list[str], most: int = CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of all trigrams around a letter (word edges count as symbol 0) and the text each is from, for ``most`` characters at a time."""
    joined = "\n".join(["", *texts, ""])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)]) + 1
    for at in range(0, max(1, len(joined) - 2), most):
        points = np.frombuffer(joined[at : at + most + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = letter_table()[points].astype(np.int32)
        middle = np.flatnonzero(symbols[1:-1]) + 1
        codes = (symbols[middle - 1] * SYMBOLS + symbols[middle]) * SYMBOLS + symbols[middle + 1]
        yield codes, np.searchsorted(starts, middle + at, side="right") - 1


def letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * np.int8(2) - np.int8(1)


def bind(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The vector of each trigram."""
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    totals: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in totals.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["lang", "code", "n"])
        totals.clear()

    for b in batches:
        langs, texts = b.column(0).to_pylist(), texts_of(b.column(1))
        for i, j in slices(texts, 1 << 20):
            names = sorted(set(langs[i:j]))
            kinds = np.array([names.index(x) for x in langs[i:j]])
            for codes, owner in trigrams(texts.slice(i, j - i).to_pylist()):
                kind = kinds[owner]
                for k, name in enumerate(names):
                    n = np.bincount(codes[kind == k], minlength=CODES)
                    totals[name] = totals[name] + n if name in totals else n
            if len(totals) > 32:
                yield from rows()
    yield from rows()


def _bundle(dimensions: int, seed: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        codes, n, letters = table["code"].to_numpy(), table["n"].to_numpy().astype(np.float64), letter_vectors(dimensions, seed)
        total = np.zeros(dimensions)
        for i in range(0, len(codes), 512):
            total += n[i : i + 512] @ bind(codes[i : i + 512], letters).astype(np.float64)
        return pa.table({"lang": [key[0].as_py()], "vector": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return run


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = 7) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all of ``docs`` (lang, text); only one vector a language reaches the driver."""
    known = chosen(docs.where(F.col("lang").isNotNull()), ("lang", "string"), ("text", "string"))
    counts = known.mapInArrow(trimmed(_count), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").applyInArrow(_bundle(dimensions, seed), "lang string, vector array<double>").collect()
    made = {r["lang"]: np.array(r["vector"]) for r in sorted(rows, key=lambda r: r["lang"])}
    return {k: v / np.linalg.norm(v) for k, v in made.items() if v.any()}


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
PREDICTED_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(prototypes: dict[str, np.ndarray], seed: int):
    names = list(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        matrix = np.array([prototypes[n] for n in names])
        letters = letter_vectors(matrix.shape[-1], seed) if names else None
        products = np.full((len(names), CODES), np.nan, np.float64)  # filled as trigrams are met
        for b in batches:
            texts = texts_of(b.column(2))
            for i, j in slices(texts, 1 << 20):
                n = j - i
                lettered, cosines = np.zeros(n, bool), np.zeros((len(names), n))
                for codes, owner in trigrams(texts.slice(i, n).to_pylist()):
                    lettered |= np.bincount(owner, minlength=n) > 0
                    if names:
                        fresh = np.unique(codes[np.isnan(products[0, codes])])
                        for k in range(0, len(fresh), 512):
                            part = fresh[k : k + 512]
                            products[:, part] = matrix @ bind(part, letters).T.astype(np.float64)
                        for k in range(len(names)):
                            cosines[k] += np.bincount(owner, weights=products[k][codes], minlength=n)
                best = cosines.argmax(axis=0) if names else np.zeros(n, int)
                positive = np.maximum(cosines, 0).sum(axis=0)
                found = lettered & (positive > 0)
                top = cosines[best, np.arange(n)] if names else np.zeros(n)
                score = np.divide(top, positive, out=np.zeros(n), where=found)
                lang = [names[k] if ok and names else "und" for k, ok in zip(best, lettered, strict=True)]
                yield batch(PREDICTED_ARROW, doc_id=b.column(0).slice(i, n), held_out=b.column(1).slice(i, n), lang_pred=lang, score=np.clip(score, 0, 1))

    return run


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = 7) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row; the prototypes are one vector a language."""
    held_out, _ = learned("doc_id", 4, 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(prototypes, seed), PREDICTED)


def langid(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32 rest is not 2, then predict every row."""
    _, use = learned("doc_id", 4, 2)
    return identify(docs, learn(docs.where(use)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) whose language is told; ``und`` rows go. Learns as :func:`langid` does."""
    _, use = learned("doc_id", 4, 2)
    known, at = learn(docs.where(use)), docs.columns.index("text")
    predict = _predict(known, 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def asked() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j in slices(texts_of(b.column(at)), 1 << 20):
                    waiting.append(b.slice(i, j - i))
                    yield pa.RecordBatch.from_arrays([pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.bool_()), b.column(at).slice(i, j - i)], names=["doc_id", "held_out", "text"])

        for told in predict(asked()):  # one slice in, one slice out
            yield waiting.pop(0).filter(pa.array([x != "und" for x in told.column("lang_pred").to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
