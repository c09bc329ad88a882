"""Audit of how the word use of sources differs, source by source and word by word.

Every source of a language is compared with every other one, and with its language as a whole, by
the squared difference of smoothed term shares, in integers throughout. A term's share in a source
depends on its count there alone, its *level*. So the terms of a language become a 0/1 matrix with a
column for each (source, level); that matrix transposed times itself holds, for each two sources,
the joint table of their levels, and each cell of a table is priced once. The products are taken
in blocks of terms and tiles of sources. A level of 0 has no column: what it contributes
follows from the single columns and the number of terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import read_table, written

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
BLOCK_TERMS = 8_192
"""Terms of a language that one task multiplies."""
TILE = 64
"""Sources of a language that meet in a task, and as many on the other side."""
MOST_COLUMNS, MOST_ROWS = 512, 4_096
"""Size of a single product: different (source, level) columns and terms."""
HELD = 1 << 18
"""Different terms a task counts before it passes them on."""
PART = 1 << 20

_LETTER = b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_LETTERS = bytes(b if b in _LETTER else 0x20 for b in bytes(range(256)).lower())


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a whole text, in parts of bounded size."""
    clean, at = text.translate(_LETTERS), 0
    while len(clean) - at > PART:
        cut = clean.find(b" ", at + PART)
        if cut < 0:
            break
        yield clean[at:cut].split()
        at = cut
    yield clean[at:].split()


COUNTED = "lang string, source string, term binary, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a (lang, source), as far as a task has seen them."""
    held: dict[tuple, dict] = defaultdict(dict)
    size = 0

    def settled() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            n = len(terms)
            values = np.array(list(terms.values()), np.int64).reshape(n, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array(list(terms), pa.binary()),
                    pa.array(values[:, 0]),
                    pa.array(values[:, 1]),
                ],
                [c.split()[0] for c in COUNTED.split(", ")],
            )
        held.clear()

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
            terms = held[lang, source]
            own: dict[bytes, int] = {}
            for words in _terms(text.as_py() or b""):
                for word in words:
                    own[word] = own.get(word, 0) + 1
            size -= len(terms)
            for word, n in own.items():
                seen = terms.get(word)
                if seen is None:
                    terms[word] = [n, 1]
                else:
                    seen[0] += n
                    seen[1] += 1
            size += len(terms)
            if size > HELD:
                yield from settled()
                size = 0
    yield from settled()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a term in thousand-millionths, exact at any size of the counts."""
    above = (n.cast("decimal(19,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    share = F.call_function("div", above, (total + terms).cast("decimal(20,0)"))
    return (F.lit(1) + share).cast("long")


def _cost(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _costs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Side:
    """The 0/1 matrix of some terms: a column for each (source, level) among their cells."""

    def __init__(self, cells: pd.DataFrame, row: np.ndarray, rows: int):
        column, first = np.unique(cells["column"].to_numpy(), return_inverse=True)
        self.ones = np.zeros((rows, len(column)), np.float32)
        self.ones[row, first] = 1
        at = np.zeros(len(column), np.int64)
        at[first] = np.arange(len(first))
        self.source = cells["source"].to_numpy()[at]
        self.p, self.p0 = (cells[c].to_numpy(np.int64)[at] for c in ("p", "p0"))


def _priced(left: _Side, right: _Side) -> pd.DataFrame:
    """Joint tables of all sources of both sides, priced in both directions.

    Sums of up to 4096 ones are exact in single precision. A cell (a, b) stands for the terms of
    levels a and b; of its price goes what (a, 0), (0, b) and (0, 0) are charged elsewhere.
    """
    table = left.ones.T @ right.ones
    i, j = np.nonzero(table)
    apart = left.source[i] != right.source[j]
    i, j = i[apart], j[apart]
    n = table[i, j].astype(np.int64)
    out = []
    for a, b, x, y in ((left, right, i, j), (right, left, j, i)):
        p, p0, q, q0 = a.p[x], a.p0[x], b.p[y], b.p0[y]
        value = n * (_costs(p, q) - _costs(p, q0) - _costs(p0, q) + _costs(p0, q0))
        out.append(pd.DataFrame({"source": a.source[x], "item": b.source[y], "value": value}))
    return pd.concat(out if left is not right else out[:1])


def _block(cells: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Products over the terms of a block, like counts beside like, in bounded matrices."""
    cells = cells.sort_values(["total", "term", "source"], ignore_index=True)
    cells["column"] = pd.factorize(
        pd.MultiIndex.from_arrays([cells["source"], cells["n"]]), sort=False
    )[0]
    term = (cells["term"] != cells["term"].shift()).cumsum().to_numpy() - 1
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    column, ends = cells["column"].to_numpy(), np.append(begin[1:], len(cells))
    at = 0
    while at < len(begin):
        # As many terms as leave the matrix small: their different columns are counted.
        upto, seen = at, set()
        while upto < len(begin) and upto - at < MOST_ROWS:
            seen.update(column[begin[upto] : ends[upto]].tolist())
            if len(seen) > MOST_COLUMNS and upto > at:
                break
            upto += 1
        part = slice(begin[at], ends[upto - 1])
        some, row = cells.iloc[part], term[part] - at
        sides = []
        for tile in ("left", "right"):
            on = some[tile].to_numpy()
            sides.append(_Side(some[on], row[on], upto - at) if on.any() else None)
        both = bool((some["left"] & some["right"]).all())
        if both:
            yield _priced(sides[0], sides[0])
        elif all(sides):
            yield _priced(*sides)
        at = upto


def _products(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    lang, _, left, right = key
    cells["left"], cells["right"] = cells["tile"] == left, cells["tile"] == right
    found = pd.concat(
        [pd.DataFrame({"source": [], "item": [], "value": np.zeros(0, np.int64)}), *_block(cells)]
    )
    found = found.groupby(["source", "item"], as_index=False)["value"].sum()
    return found.assign(lang=lang)[["lang", "source", "item", "value"]]


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, total``: terms in ``least_docs`` documents of a language at least.

    ``n`` are the term's occurrences in the source, ``total`` those in the language.
    """
    texts = docs.select(*_names(), F.col("text").cast("binary"))
    counted = texts.mapInArrow(_counted, COUNTED)
    # Added up by source first, so that a frequent term is one row for each source afterwards.
    counted = counted.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    in_lang = Window.partitionBy("lang", "term")
    counted = counted.withColumns(
        {"total": F.sum("n").over(in_lang), "lang_docs": F.sum("docs").over(in_lang)}
    )
    counted = counted.filter(F.col("lang_docs") >= least_docs)
    return counted.select("lang", "source", "term", "n", "total")


def _names() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def groups_of(docs: DataFrame, cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Each (lang, source) that occurs: ``size`` of it, ``lang_size``, ``terms`` and ``tile``.

    Sizes are occurrences of kept terms; ``terms`` is the number of kept terms of the language.
    """
    found = docs.select(*_names()).distinct()
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    kept = cells.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    found = found.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
    found = found.fillna(0, ["size", "terms"])
    in_lang = Window.partitionBy("lang")
    place = F.row_number().over(in_lang.orderBy("source")) - 1
    return found.select(
        "*",
        F.sum("size").over(in_lang).alias("lang_size"),
        F.floor(place / tile).cast("int").alias("tile"),
    )


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the cost of each source against each other one as a model."""
    no = F.lit(0).cast("long")
    sized = groups.select("lang", "source", "tile", "size", "terms")
    sized = sized.withColumn("p0", _share(no, F.col("size"), F.col("terms")))
    sized = written(sized.filter("terms > 0"), "groups")
    rows = cells.join(sized, ["lang", "source"]).withColumn(
        "p", _share(F.col("n"), F.col("size"), F.col("terms"))
    )
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    # A row goes to its own tile's products with every tile of its language.
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    rows = rows.join(tiles, "lang").withColumn("other", F.explode(F.expr("sequence(0, last)")))
    rows = rows.withColumns(
        {"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")}
    )
    joint = (
        rows.select("lang", "block", "tile_a", "tile_b", "tile", "source", "term", "n", "total", "p", "p0")
        .groupBy("lang", "block", "tile_a", "tile_b")
        .applyInPandas(_products, "lang string, source string, item string, value long")
    )
    joint = joint.groupBy("lang", "source", "item").agg(F.sum("value").alias("joint"))
    # Single columns of the matrix: how many terms have each level of each source.
    levels = rows.filter("other = tile").groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    levels = written(levels, "levels")
    model = sized.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    own = sized.select("lang", "source", "p0", "terms")
    # Every other source of the language is asked for, so all pairs of names are wanted here.
    pairs = own.join(model, "lang").filter("source <> item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    above = levels.join(own.drop("terms"), ["lang", "source"]).join(model, "lang")
    above = above.filter("source <> item").groupBy("lang", "source", "item")
    above = above.agg(F.sum(F.col("n") * (_cost(p, q0) - _cost(p0, q0))).alias("above"))
    below = levels.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "n")
    below = below.join(model, ["lang", "item"]).join(own.drop("terms"), "lang")
    below = below.filter("source <> item").groupBy("lang", "source", "item")
    below = below.agg(F.sum(F.col("n") * (_cost(p0, F.col("q")) - _cost(p0, q0))).alias("below"))
    for part in (joint, above, below):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    pairs = pairs.fillna(0, ["joint", "above", "below"])
    value = F.col("joint") + F.col("above") + F.col("below") + F.col("terms") * _cost(p0, q0)
    known = pairs.select("lang", "source", "item", value.alias("value"))
    bare = groups.filter("terms = 0").select("lang", "source")
    empty = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    return known.unionByName(empty.withColumn("value", no))


def term_values(cells: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """Terms more frequent in a source than in its language, the ``top`` of each by cost."""
    sized = groups.select("lang", "source", "size", "lang_size", "terms")
    rows = cells.join(sized, ["lang", "source"]).select(
        "lang",
        "source",
        F.col("term").cast("string").alias("item"),
        _share(F.col("n"), F.col("size"), F.col("terms")).alias("p"),
        _share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q"),
    )
    rows = rows.filter("p > q").withColumn("value", _cost(F.col("p"), F.col("q")))
    return _with_rank(rows.select("lang", "source", "item", "value")).filter(F.col("rank") <= top)


def _with_rank(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` over all rows of ``docs (text, lang, source)``.

    Part ``pair`` ranks every other source of the language by how badly it predicts this one, part
    ``term`` the terms that mark a source within its language. A null text, lang or source is
    empty; an empty name is a name. A source without terms takes part, and where a language has no
    kept term all its pairs cost 0. Ties go to the smaller item in UTF-8. Repeated rows
    count each; no rows give no rows; other columns are not looked at.
    """
    cells = written(term_counts(docs, least_docs), "terms")
    groups = written(groups_of(docs, cells), "sources")
    pairs = _with_rank(pair_values(cells, groups)).withColumn("part", F.lit("pair"))
    terms = term_values(cells, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``."""
    return audit(read_table(spark, sf_dir, "documents"))


SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3
), sources AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, source, sum(n) AS size FROM counts GROUP BY ALL
), langs AS (
  SELECT lang, sum(total) AS size, count(*) AS terms FROM kept GROUP BY lang
), cells AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.total, l.size AS lang_size,
    coalesce(z.size, 0) AS size, l.terms
  FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
  LEFT JOIN sizes z ON z.lang = s.lang AND z.source = s.source
), shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 1)) // (size + terms)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (total + 1)) // (lang_size + terms)::HUGEINT AS q
  FROM cells
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), results AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM results
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ordered
WHERE part = 'pair' OR rank <= 200
"""
