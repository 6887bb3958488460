"""Phrase collocations by sorted, truncated suffixes.

Every word starts a suffix of at most ``LONGEST`` words that ends with its piece. Tasks count equal suffixes of some text, and send them by
language and first word. There they are sorted in reverse byte order, so that all suffixes with a common prefix are neighbours, and a stack of
one open prefix for each length counts all phrases in one pass. Phrases seen at least ``least`` times are a small table, which is joined with
itself: a candidate with the parts of each of its cuts, and with the longer candidates that hold it.

A first word with a large share of all words would make one task slow, so words, pairs and triples that are at least one in ``HEAVY`` words
of some text are counted beforehand (at most twice ``HEAVY`` of each length are kept), and their suffixes are sent by one word more. Counts of
such a prefix come from several tasks and are added up; all others are whole where they are counted.

A null text is empty; a null language is ``und``. Equal rows count each. Other columns play no part. A language without words has no rows, and an
empty table gives none. A language with fewer phrases than asked for gives those it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import blocks, partitions, raw, ship, written

LONGEST, LEAST, TOP, SHADOW, UNKNOWN = 4, 30, 2000, 80, "und"
#: A prefix of one in so many words is spread over several tasks.
HEAVY = 400
#: Bits of a word's number in a packed suffix.
_WIDE = 16
#: Ends of pieces become full stops, and tabs blanks.
_PIECES = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d\x09", b"." * 9 + b" ")
_PLACES = 1 << 20

ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM lists WHERE len(w) > 0),
grams AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS k FROM starts),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS n FROM grams WHERE i + k - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= 30),
cuts AS (SELECT lang, phrase, k, w, a, unnest(generate_series(1, k - 1)) AS cut FROM c),
scored AS (
  SELECT cuts.*, x.n AS l, y.n AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.n AS HUGEINT) + y.n) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1 : cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1 :], ' ')
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_spans AS (SELECT lang, w, k, a, unnest([2, 3]) AS m FROM c),
inner_starts AS (SELECT lang, w, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM inner_spans WHERE m < k),
longer AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS most FROM inner_starts GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, total.n AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def _tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The different words of texts, escaped, and the numbers of all words, with the full stop's, which no word holds, after each piece; word 0 is empty."""
    line = _escaped(b".".join(texts).lower().translate(_PIECES).replace(b".", b" . "))
    found = pc.split_pattern(pa.array([b" . " + line], pa.large_binary()), b" ").flatten().dictionary_encode()
    numbers = found.indices.to_numpy()
    return found.dictionary.cast(pa.binary()), numbers[numbers > 0]  # 0 is the empty string before the first blank, 1 the full stop


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.Array, np.ndarray]]:
    for batch in batches:
        texts: dict[bytes, list[bytes]] = {}
        for lang, text in zip(raw(batch.column(0)), raw(batch.column(1)), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            yield lang, *_tokens(some)


def _numbered(words: pa.Array, numbers: np.ndarray, longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Parts of a list of words, each with its different words and rows of the numbers of its suffixes; 0 stands behind a suffix's end.

    A part has as many words as fit into a packed suffix.
    """
    at, step = 0, len(numbers)
    while at < len(numbers):
        part = numbers[at : at + step + longest - 1]
        if len(words) < 1 << _WIDE:
            own, part = words, np.where(part == 1, 0, part)
        else:
            some, part = np.unique(np.append(1, part), return_inverse=True)
            own, part = words.take(pa.array(some)), part[1:]
            if len(own) > 1 << _WIDE:
                step = max(1 << (_WIDE - 1), step // 2)
                continue
        n = min(step, len(numbers) - at)
        padded = np.append(part, np.zeros(longest, np.int64)).astype(np.int64)
        rows = np.zeros((longest, n), np.int64)
        rows[0] = padded[:n]
        for k in range(1, longest):
            rows[k] = np.where(rows[k - 1] > 0, padded[k : k + n], 0)
        yield own, rows[:, rows[0] > 0]
        at += n


def _packed(rows: np.ndarray) -> np.ndarray:
    key = rows[0].astype(np.uint64)
    for r in rows[1:]:
        key = key << np.uint64(_WIDE) | r.astype(np.uint64)
    return key


def _unpacked(keys: np.ndarray, longest: int) -> np.ndarray:
    return np.array([(keys >> np.uint64(_WIDE * (longest - 1 - k)) & np.uint64((1 << _WIDE) - 1)).astype(np.int64) for k in range(longest)]).reshape(longest, len(keys))


def _escaped(word: bytes) -> bytes:
    """Bytes without byte 0, which ends words in a sorted suffix; the order of words stays."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x00" in word or b"\x01" in word else word


def _plain(word: bytes) -> bytes:
    return word.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01") if b"\x01" in word else word


def _texts(rows: np.ndarray, words: pa.Array, lang: bytes) -> pa.Array:
    """Language and words of each row of numbers, each ended by a byte 0."""
    every = pa.concat_arrays([pa.array([_escaped(lang), b""], words.type), words])
    n = rows.shape[1]
    grid = np.concatenate([np.zeros((1, n), np.int64), rows + 2, np.ones((1, n), np.int64)]).T
    there = grid != 2
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32)), every.take(pa.array(grid[there])))
    return pc.binary_join(lists, b"\0").cast(pa.binary())


def _heavy(docs: DataFrame, longest: int) -> dict[bytes, None]:
    """Prefixes (language and words) of one in ``HEAVY`` words or more of some text and of half as much of all: at most 2 * HEAVY of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, every, numbers in _by_language(blocks(batches)):
            for words, rows in _numbered(every, numbers, longest):
                for k in range(1, longest):
                    keys, counts = np.unique(_packed(rows[:k][:, rows[k - 1] > 0]), return_counts=True)
                    many = counts * HEAVY >= rows.shape[1]
                    texts = _texts(_unpacked(keys[many], k), words, lang)
                    yield pa.RecordBatch.from_arrays([texts, pa.array(counts[many]), pa.array(np.zeros(len(texts), np.int64))], ["s", "c", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0]), pa.array([rows.shape[1]])], ["s", "c", "n"])

    seen = written(docs.mapInArrow(run, "s binary, c bigint, n bigint").groupBy("s").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "heavy")
    total = seen.agg(F.sum("n")).first()[0] or 0
    return dict.fromkeys(bytes(r["s"]) for r in seen.filter((F.col("c") * 2 * HEAVY >= total) & F.col("s").isNotNull()).select("s").collect())


def _suffixes(docs: DataFrame, heavy: dict[bytes, None], longest: int) -> DataFrame:
    """place, s, c: counted suffixes, and by what they are sent."""
    known = sorted({w for h in heavy for w in h.split(b"\0")[1:-1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, every, numbers in _by_language(blocks(batches)):
            for words, rows in _numbered(every, numbers, longest):
                keys, counts = np.unique(_packed(rows), return_counts=True)
                rows = _unpacked(keys, longest)
                own = np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], np.uint64)
                number = dict(zip(known, pc.index_in(pa.array(known, words.type), value_set=words).to_pylist(), strict=True))
                place = np.full(len(keys), xxhash.xxh64_intdigest(lang), np.uint64)
                deeper = np.ones(len(keys), bool)
                for k in range(1, longest + 1):
                    place = np.where(deeper & (rows[k - 1] > 0), (place ^ own[rows[k - 1]]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1), place)
                    mine = [[number.get(w) for w in h.split(b"\0")[1:-1]] for h in heavy if h.startswith(_escaped(lang) + b"\0") and h.count(b"\0") == k + 1]
                    mine = np.array([m for m in mine if None not in m], np.int64).reshape(-1, k).T
                    deeper &= np.isin(_packed(rows[:k]), _packed(mine)) if mine.size else False
                texts = _texts(rows, words, lang)
                for at in range(0, len(texts), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array((place[at : at + 65_536] % np.uint64(_PLACES)).astype(np.int32)), texts[at : at + 65_536], pa.array(counts[at : at + 65_536])], ["place", "s", "c"])

    return docs.mapInArrow(run, "place int, s binary, c bigint")


def _counted(suffixes: DataFrame, heavy: dict[bytes, None], least: int, longest: int) -> DataFrame:
    """lang, k, phrase, f of sorted suffixes in each task; k = 0: all words of a language. Heavy prefixes may be seen by several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = [h.split(b"\0")[:-1] for h in heavy]
        ends_of = [pa.array({h[k] for h in split if len(h) == k + 1}, pa.binary()) for k in range(longest + 1)]
        open_words: list[bytes] = []  # language and words of the suffix before
        stack = [0] * (longest + 1)  # how often each of its prefixes was seen so far
        out: list[tuple[bytes, int, bytes, int]] = []

        def close(words: list[bytes], k: int, n: int) -> None:
            if k == 0 or n >= least or b"".join(w + b"\0" for w in words[: k + 1]) in heavy:
                out.append((_plain(words[0]), k, b" ".join(map(_plain, words[1 : k + 1])), n))

        def flush() -> pa.RecordBatch:
            lang, k, phrase, f = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.binary()).cast(pa.string()), pa.array(k, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], ["lang", "k", "phrase", "f"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            parts = pc.split_pattern(batch.column(0), b"\0")
            offsets = parts.offsets.to_numpy()
            size = np.diff(offsets) - 2  # words; the last part is empty
            flat = parts.flatten().dictionary_encode()
            numbers, names = flat.indices.to_numpy(), flat.dictionary
            rows = np.full((longest + 1, n), -1, np.int64)
            for k in range(longest + 1):
                there = size >= k
                rows[k, there] = numbers[offsets[:-1][there] + k]
            sums = np.concatenate([[0], np.cumsum(batch.column(1).to_numpy())])
            own = lambda i, names=names, rows=rows: [names[int(x)].as_py() for x in rows[:, i] if x >= 0]
            first = own(0)
            common = 0
            while common < min(len(first), len(open_words)) and first[common] == open_words[common]:
                common += 1
            for k in range(len(open_words) - 1, common - 1, -1):
                close(open_words, k, stack[k])
                stack[k] = 0
            changed = np.zeros(n, bool)
            changed[0] = True
            for k in range(longest + 1):
                changed[1:] |= rows[k, 1:] != rows[k, :-1]
                starts = np.flatnonzero(changed)
                ends = np.append(starts[1:], n)
                found = sums[ends] - sums[starts]
                if rows[k, 0] >= 0:
                    found[0] += stack[k]
                real = rows[k, starts] >= 0
                last = real[-1]
                stack[k] = int(found[-1]) if last else 0
                real[-1] = False
                wanted = real & (found >= least) if k else real
                if 0 < k < longest and len(ends_of[k]):
                    some = pc.index_in(ends_of[k], value_set=names).drop_null().to_numpy()
                    wanted |= real & np.isin(rows[k, starts], some)
                for j in np.flatnonzero(wanted).tolist():
                    close(own(starts[j]), k, int(found[j]))
            open_words = own(n - 1)
            if len(out) >= 10_000:
                yield flush()
        for k in range(len(open_words)):
            close(open_words, k, stack[k])
        if out:
            yield flush()

    n = partitions(suffixes.sparkSession)
    ordered = suffixes.repartition(n, "place").sortWithinPartitions(F.desc("s")).select("s", "c")
    parts = ordered.mapInArrow(run, "lang string, k int, phrase string, f bigint")
    return parts.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, k, phrase, f: all phrases of up to ``longest`` words that docs(lang, text) have at least ``least`` times; for k = 0 all words of a language."""
    if not 1 <= longest <= 4:
        raise ValueError("phrases have 1 to 4 words")
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    heavy = _heavy(docs, longest)
    return _counted(_suffixes(docs, heavy, longest), heavy, least, longest)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shadow: int = SHADOW, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by their worst cut's Dice coefficient in millionths.

    A phrase goes where a longer candidate that holds it has ``shadow`` percent of its occurrences.
    """
    counts = written(phrase_counts(docs, least, longest), "phrases")
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    f = counts.filter("k > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    c = counts.filter("k > 1").select("lang", "k", "phrase", words.alias("w"), F.col("f").alias("a"))
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = c.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("_left"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(f.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("cast(cast(2000000 as decimal(19, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as bigint)")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    spans = c.filter("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    longer = spans.select("lang", joined(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = lambda c, n: F.col(c).cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)")
    kept = worst.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (wide("most", 100) < wide("a", shadow)))
    # the best of each of many parts of a language, then the best of these
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession)))
    some = kept.withColumn("_part", part).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_nth") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the 2,000 best phrases of each language of all ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
