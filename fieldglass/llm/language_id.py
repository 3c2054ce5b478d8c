"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import words as W
from fieldglass.llm.shared import new_path, renamed, written

#: Characters of the longest n-gram; a character is a UTF-16 code unit, so that a gram is 64 bits and stands for itself.
ORDER = 4
#: Characters that an unseen one is taken to be one of.
ALPHABET = 65536
#: One in so many learned documents, by the hash of its text, is kept out of a second model and scored by it, to fit the
#: temperature and the limits of rejection.
FOLDS = 4
TEMPERATURES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
UNDETERMINED = "und"
#: Cross-entropies above this share of a language's own documents are rejected, and never below LEAST_EXCESS deviations.
REJECT_ABOVE, LEAST_EXCESS = 0.999, 4.0
#: Different grams that a worker keeps at once: about 100 MB.
MOST_GRAMS = 1 << 21

_LETTER = np.zeros(1 << 16, bool)
_LETTER[[c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True


def characters(data: bytes) -> tuple[np.ndarray, bool]:
    """UTF-16 units of lower-cased letters, other runs being one 0x20; and whether there is a letter."""
    code = np.frombuffer(data.decode("utf-8", "replace").lower().encode("utf-16-le"), np.uint16)
    letter = _LETTER[code]
    high = np.flatnonzero(code >> 10 == 0x36)
    if len(high):
        point = 0x10000 + ((code[high].astype(np.int64) & 0x3FF) << 10) + (code[high + 1] & 0x3FF)
        kinds, number = np.unique(point, return_inverse=True)
        alpha = np.array([chr(c).isalpha() for c in kinds.tolist()])[number]
        letter[high], letter[high + 1] = alpha, alpha
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, code, 0x20)[keep].astype(np.uint64), bool(letter.any())


def grams_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: (first row, their n-grams, each row's first, which rows have a letter).

    A row's first letters have a context of spaces.
    """
    data, at = W.texts(column)
    for i, j in W.chunks(at):
        parts = [characters(data[a:b].tobytes()) for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]
        lead = np.full(ORDER - 1, 0x20, np.uint64)
        flat = np.concatenate([x for p in parts for x in (lead, p[0])])
        sizes = np.array([len(p[0]) for p in parts])
        gram = np.zeros(max(0, len(flat) - ORDER + 1), np.uint64)
        for k in range(ORDER):
            gram = gram << np.uint64(16) | flat[k : k + len(gram)]
        begin = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
        own = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        yield i, gram[own], np.concatenate([[0], np.cumsum(sizes)]), np.array([p[1] for p in parts])


def numbered(known: W.Numbering, grams: np.ndarray) -> np.ndarray:
    """The number of each gram; those that weren't known are now."""
    number = known.find(grams)
    missing = np.flatnonzero(number < 0)
    if len(missing):
        known.add(np.unique(grams[missing]))
        number[missing] = known.find(grams[missing])
    return number


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, tested, text) -> lang, tested, gram, n over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kinds, counts = W.Numbering(), {}, []

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, tested), k in kinds.items():
                used = np.flatnonzero(counts[k])
                columns = [pa.array([lang] * len(used), pa.string()), pa.array([tested] * len(used), pa.bool_()),
                    pa.array(known.keys[0][used].view(np.int64)), pa.array(counts[k][used])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "tested", "gram", "n"])

        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for i, grams, at, _ in grams_of(batch.column(2)):
                number = numbered(known, grams)
                kind = np.array([kinds.setdefault(x, len(kinds)) for x in pairs[i : i + len(at) - 1]])
                counts += [np.zeros(0, np.int64) for _ in range(len(kinds) - len(counts))]
                each = np.repeat(kind, np.diff(at))
                for k in np.unique(kind).tolist():
                    new = np.bincount(number[each == k], minlength=known.n)
                    new[: len(counts[k])] += counts[k]
                    counts[k] = new
                if known.n > MOST_GRAMS // max(1, len(kinds)):
                    yield from rows()
                    known, kinds, counts = W.Numbering(), {}, []
        yield from rows()

    return docs.select("lang", "tested", "text").mapInArrow(run, "lang string, tested boolean, gram long, n long").groupBy("lang", "tested",
        "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """counts (part, lang, gram, n) of ORDER-grams -> part, lang, size, gram, p, rest.

    p is the interpolated probability of a gram's last character after the others; rest is what a gram as a context leaves
    to the next shorter one. Shorter grams count the different characters before them instead of occurrences. The discount of
    an order is n1 / (n1 + 2 * n2), from how many grams count 1 and 2. What an order needs of another is written once.
    """
    key = ["part", "lang"]
    by_size = {ORDER: counts.select(*key, "gram", F.col("n").cast("double").alias("n"))}
    for size in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 16 * size) - 1))
        by_size[size] = written(by_size[size + 1].groupBy(*key, tail.alias("gram")).agg(F.count("*").cast("double").alias("n")), "grams")
    rows = solved = None
    for size in range(1, ORDER + 1):
        grams = by_size[size].withColumn("context", F.shiftrightunsigned("gram", 16) if size > 1 else F.lit(0).cast("long"))
        ones, twos = (F.sum((F.col("n") == k).cast("double")) for k in (1, 2))
        discount = grams.groupBy(*key).agg(F.least(F.greatest(ones / F.greatest(ones + 2 * twos, F.lit(1.0)), F.lit(0.1)), F.lit(0.9)).alias("d"))
        sums = grams.groupBy(*key, "context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        contexts = written(sums.join(discount, key).withColumn("rest", F.col("d") * F.col("kinds") / F.col("all")), "contexts")
        known = grams.join(contexts, [*key, "context"])
        if size == 1:
            known = known.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            tail = F.col("gram").bitwiseAND(F.lit((1 << 16 * (size - 1)) - 1))
            known = known.withColumn("tail", tail).join(solved.select(*key, F.col("gram").alias("tail"), F.col("p").alias("lower")), [*key, "tail"])
        p = ((F.col("n") - F.col("d")) / F.col("all") + F.col("rest") * F.col("lower")).alias("p")
        solved = written(known.select(*key, "gram", p), "solved")
        none = F.lit(None).cast("double")
        own = solved.select(*key, F.lit(size).alias("size"), "gram", "p", none.alias("rest")).unionByName(
            contexts.select(*key, F.lit(size - 1).alias("size"), F.col("context").alias("gram"), none.alias("p"), "rest")
        )
        rows = own if rows is None else rows.unionByName(own)
    return rows


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", tested: Column | None = None) -> str:
    """Write a model of the rows' languages, and return its path: part, lang, size, gram, logp, logrest.

    Part 0 is learned from all rows, part 1 from those that aren't `tested`.
    """
    test = F.lit(False) if tested is None else tested
    known = renamed(docs, lang=F.col(lang_col), text=F.col(text_col), tested=test).filter("lang is not null and text is not null")
    counts = written(gram_counts(known), "grams")
    every = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).select(F.lit(0).alias("part"), "lang", "gram", "n")
    both = every if tested is None else every.union(counts.filter("not tested").select(F.lit(1), "lang", "gram", "n"))
    rows = kneser_ney(written(both, "counts")).groupBy("part", "lang", "size", "gram")
    folded = rows.agg(F.max(F.log2("p")).cast("float").alias("logp"), F.max(F.log2("rest")).cast("float").alias("logrest"))
    path = new_path(docs.sparkSession, "language_model")
    folded.write.parquet(path)
    return path


class Model:
    """Sorted arrays of hashed grams for each language and order. The hash is a bijection, so no two grams share one."""

    def __init__(self, table: pa.Table):
        self.langs = sorted(set(table.column("lang").unique().to_pylist()))
        lang, size = (table.column(k).to_numpy(zero_copy_only=False) for k in ("lang", "size"))
        code = W.mix(table.column("gram").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        logp, rest = (table.column(k).to_numpy(zero_copy_only=False).astype(np.float32) for k in ("logp", "logrest"))
        self.p: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        self.rest: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for x in self.langs:
            for k in range(ORDER + 1):
                own = np.flatnonzero((lang == x) & (size == k))
                own = own[np.argsort(code[own])]
                for values, into in ((logp, self.p), (rest, self.rest)):
                    there = own[~np.isnan(values[own])]
                    into[x, k] = code[there], values[there]
        self.clear()

    def clear(self) -> None:
        self.known, self.scores = W.Numbering(), np.zeros((0, len(self.langs)), np.float32)

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(grams), bool), np.zeros(len(grams), np.float32)
        codes = W.mix(grams)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return keys[at] == codes, values[at]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """log2 of each gram's last character's probability after the others, for every language."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        for column, lang in enumerate(self.langs):
            total, todo = np.zeros(len(grams), np.float32), np.arange(len(grams))
            for size in range(ORDER, 0, -1):
                tail = grams[todo] & np.uint64((1 << 16 * size) - 1)
                seen, value = self.find(self.p[lang, size], tail)
                out[todo[seen], column] = total[todo[seen]] + value[seen]
                todo, tail = todo[~seen], tail[~seen]
                there, value = self.find(self.rest[lang, size - 1], tail >> np.uint64(16))
                total[todo] += np.where(there, value, 0)
            out[todo, column] = total[todo] - np.log2(ALPHABET)
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character of every row by every language, the rows' characters, and which rows have a letter."""
        rows, letters, sizes = [np.zeros((0, len(self.langs)))], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
        for _, grams, at, letter in grams_of(column):
            if self.known.n > MOST_GRAMS:
                self.clear()
            before = self.known.n
            number = numbered(self.known, grams)
            if self.known.n > before:
                self.scores = np.concatenate([self.scores, self.of(self.known.keys[0][before : self.known.n])])
            # Sums by row: differences of running sums would lose digits in long batches.
            sums = np.zeros((len(at) - 1, len(self.langs)))
            full = np.flatnonzero(np.diff(at))
            for k in range(len(self.langs) if len(full) else 0):
                sums[full, k] = np.add.reduceat(self.scores[number, k].astype(np.float64), at[:-1][full])
            rows.append(-sums / np.maximum(1, np.diff(at))[:, None])
            letters.append(letter)
            sizes.append(np.diff(at))
        return np.concatenate(rows), np.concatenate(sizes), np.concatenate(letters)


@lru_cache(maxsize=2)
def load(path: str, part: int = 0) -> Model:
    fs, root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    columns = ["lang", "size", "gram", "logp", "logrest"]
    return Model(pq.read_table(root, filesystem=fs, columns=columns, filters=[("part", "=", part)]))


def shares(bits: np.ndarray, temperature: float) -> np.ndarray:
    x = -(bits - bits.min(axis=1, keepdims=True)) * temperature
    e = np.exp(x)
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Limit:
    """A language's own texts of n characters have mean bits with a variance of between + within / n; those with more than
    `most` deviations above the mean are rejected."""

    mean: float
    between: float
    within: float
    most: float

    def over(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        return bits > self.mean + self.most * np.sqrt(self.between + self.within / np.maximum(n, 1))


def calibrate(tested: DataFrame, path: str) -> tuple[float, dict[str, Limit]]:
    """(temperature of the score, limit of each language), from all (lang, text) rows kept out of part 1 of the model.

    Only sums and one quantile of each language reach the driver. A language of which no row was kept out has no limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, 1)
        for batch in batches:
            bits, n, letter = model.entropies(batch.column(1))
            langs = batch.column(0).to_pylist()
            ok = np.array([x and lang in model.langs for x, lang in zip(letter.tolist(), langs, strict=True)], bool)
            truth = np.array([model.langs.index(lang) for lang, x in zip(langs, ok, strict=True) if x], int)
            bits, where = bits[ok], np.arange(len(truth))
            loss = [-np.log(np.maximum(shares(bits, t)[where, truth], 1e-12))
                for t in TEMPERATURES] if len(truth) else [np.zeros(0)] * len(TEMPERATURES)
            columns = [batch.column(0).filter(pa.array(ok)), pa.array(bits[where, truth]), pa.array(1.0 / n[ok])]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, loss)], ["lang", "bits", "x", *names])

    names = [f"loss{k}" for k in range(len(TEMPERATURES))]
    schema = ", ".join(["lang string, bits double, x double", *(f"{x} double" for x in names)])
    rows = written(tested.select("lang", "text").mapInArrow(run, schema), "calibration")
    means = rows.groupBy("lang").agg(F.avg("bits").alias("mean"))
    # Squared deviations as a line in x, either end of which counts alike.
    y, w = (F.col("bits") - F.col("mean")) ** 2, (F.col("x") + 0.005) ** -2
    total = lambda *of: F.sum(w * of[0] * of[1] if len(of) > 1 else w * of[0])
    x = F.col("x")
    sums = rows.join(F.broadcast(means), "lang").groupBy("lang").agg(
        F.first("mean").alias("mean"), F.sum(w).alias("w"), total(x).alias("wx"), total(x, x).alias("wxx"), total(y).alias("wy"),
        total(x, y).alias("wxy"), *(F.sum(k).alias(k) for k in names)
    )
    kinds, loss = {}, np.zeros(len(TEMPERATURES))
    for r in sums.collect():
        loss += [r[k] for k in names]
        det = r["w"] * r["wxx"] - r["wx"] ** 2
        within = max(0.0, (r["w"] * r["wxy"] - r["wx"] * r["wy"]) / det) if det > 1e-9 * r["w"] * r["wxx"] else 0.0
        between = max(1e-4, (r["wy"] - within * r["wx"]) / r["w"])
        kinds[r["lang"]] = (r["mean"], between, within)
    if not kinds:
        return 1.0, {}
    spark = tested.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in kinds.items()], "lang string, mean double, between double, within double")
    excess = (F.col("bits") - F.col("mean")) / F.sqrt(F.col("between") + F.col("within") * F.col("x"))
    most = rows.join(F.broadcast(known), "lang").groupBy("lang").agg(F.percentile_approx(excess, REJECT_ABOVE, 10_000).alias("most")).collect()
    limits = {r["lang"]: Limit(*kinds[r["lang"]], max(LEAST_EXCESS, r["most"])) for r in most}
    return TEMPERATURES[int(loss.argmin())], limits


def identify(docs: DataFrame, path: str, temperature: float = 1.0, limits: dict[str, Limit] | None = None, id_col: str = "doc_id",
    text_col: str = "text") -> DataFrame:
    """One row for every input row: doc_id, lang_pred, score, bits, rejected.

    The language with the least cross-entropy a character stands; the first in code point order of equal ones. score is its
    share among the languages; bits its cross-entropy; rejected says that bits is above the language's limit for a text of
    its length, so the text is likely none of the learned languages. A text that is null or has no letter, and any text
    where no language was learned, is `und` with score 0 and rejected. Ids may be null or repeated; other columns are ignored.
    """
    every = limits or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            bits, size, letter = model.entropies(batch.column(1))
            ok = letter & bool(model.langs)
            n = len(ok)
            best = bits.argmin(axis=1) if model.langs else np.zeros(n, int)
            names = np.array([*model.langs, UNDETERMINED], object)[np.where(ok, best, len(model.langs))]
            share = shares(bits, temperature)[np.arange(n), best] if model.langs and n else np.zeros(n)
            least = bits[np.arange(n), best] if model.langs else np.zeros(n)
            over = ~ok
            for k, lang in enumerate(model.langs):
                if lang in every:
                    over |= ok & (best == k) & every[lang].over(least, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(np.where(ok, share, 0.0)), pa.array(np.where(ok, least, 0.0)),
                pa.array(over)],
                ["doc_id", "lang_pred", "score", "bits", "rejected"],
            )

    rows = renamed(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def learn_and_identify(docs: DataFrame, parts: int = 4, part: int = 2, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that have a language and aren't held out, then identify() every row; adds held_out.

    Rows are held out if crc32 of their id as text is `part` modulo `parts`; a null id counts as empty text. Temperature
    and limits come from one in FOLDS of the rows learned from, by the hash of the text (so copies go together), scored by
    a model of the other rows.
    """
    rows = renamed(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col), lang=F.col(lang_col).cast("string"))
    test = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts)) == part
    known = rows.filter(~test & F.col("lang").isNotNull() & F.col("text").isNotNull())
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    path = fit(known, tested=fold)
    found = identify(rows, path, *calibrate(known.filter(fold), path))
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score", "bits", "rejected")
