"""How far the vocabularies of sources diverge, language by language, in exact whole numbers.

Terms are counted by (lang, source) within slices of text and then by Spark. A language
keeps the terms of at least LEAST of its documents. Terms with the same counts in all
sources have the same frequencies everywhere, so they are grouped by their sparse vector of
(source, count) and each pair of sources is evaluated once for a distinct vector, times the
number of its terms. Sources are dealt to blocks of about TILE and vectors to slices of
about VECTORS; a task holds one slice's vectors, cut to the two blocks of a tile, so neither many
sources nor a language with a third of all rows makes a task large. Original terms are ranked after that.

The frequency of a count c among N words over V kept terms is 1 + floor(10^9 (c + 5) / (N + 5 V)),
worked out in two steps of long division, exact up to 2.9 * 10^14 words a language.

Defined results: null text, lang and source are empty strings, which count as such;
documents without terms still make their (lang, source) group. Where a language keeps no
term all its pairs have divergence 0 and no term is ranked. Repeated rows and ids count as
documents of their own. A language of one source has no pairs. Terms of any length are kept whole.
Ties rank by the UTF-8 order of the item. An empty table gives an empty result; further columns
are ignored. `audit` writes its tallies and runs jobs when it is called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrow_text
from .shared import stored

LEAST, SMOOTH, SCALE, TOP, TILE, VECTORS = 30, 5, 10**9, 50, 256, 4096
#: SCALE in two factors; a count times the first and a remainder times the second fit in 63 bits.
_STEPS = (32_000, 31_250)
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice, with one empty term for each of its groups."""
    for b in arrow_text.slices(batches):
        body, offsets = arrow_text.raw(b.column(2))
        upper = (body >= 65) & (body <= 90)
        words = arrow_text.joined(arrow_text.split(body + upper.astype(np.uint8) * np.uint8(32), offsets, _BETWEEN))
        langs, sources = (b.column(k).dictionary_encode() for k in (0, 1))
        group, row_group = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
        coded = arrow_text.strings(words).dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        many = max(len(terms), 1)
        each, times = np.unique(words.row * many + code, return_counts=True)
        key = row_group[each // many] * many + each % many
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        n = np.add.reduceat(times[order], starts) if len(starts) else np.zeros(0, np.int64)
        docs = np.diff(np.append(starts, len(order)))
        found = key[order][starts] if len(starts) else key
        which = np.concatenate([found // many, np.arange(len(group))])
        term = pc.binary_slice(terms, 0, -1).take(pa.array(found % many)).cast(pa.large_string()) if len(terms) else pa.array([], pa.large_string())
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(group // len(sources.dictionary))).take(pa.array(which)).cast(pa.string()),
                sources.dictionary.take(pa.array(group % len(sources.dictionary))).take(pa.array(which)).cast(pa.string()),
                pa.concat_arrays([term, pa.array([""] * len(group), pa.large_string())]).cast(pa.string()),
                pa.array(np.append(n, np.zeros(len(group), np.int64))),
                pa.array(np.append(docs, np.zeros(len(group), np.int64))),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def tallies(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group; a group's empty term says that it occurs."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(count: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / size) of long columns."""
    part = (count + SMOOTH) * _STEPS[0]
    whole = lambda a: F.call_function("div", a, size)
    return whole(part) * _STEPS[1] + whole((part % size) * _STEPS[1]) + 1


def frequencies(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    part = (count + SMOOTH) * _STEPS[0]
    return part // size * _STEPS[1] + part % size * _STEPS[1] // size + 1


def _evaluated(key: tuple, vectors: pa.Table, tile: pa.Table) -> pa.Table:
    """The summed differences of all pairs of a tile over one slice of distinct vectors."""
    side = [(tile.column(f"{s}_source")[0].values, np.array(tile.column(f"{s}_size")[0].as_py(), np.int64)) for s in "ab"]
    names = [x[0].cast(pa.string()) for x in side]
    if key[1].as_py() == key[2].as_py():
        one, two = np.triu_indices(len(names[0]), 1)
    else:
        one, two = (x.ravel() for x in np.indices((len(names[0]), len(names[1]))))
    total = np.zeros(len(one), np.int64)
    step = max(1, (1 << 21) // max(1, len(one)))
    for start in range(0, vectors.num_rows if len(one) else 0, step):
        part = vectors.slice(start, step).combine_chunks()
        v, times = part.column("v").combine_chunks(), part.column("m").to_numpy()
        row = np.repeat(np.arange(len(v)), pc.list_value_length(v).to_numpy(zero_copy_only=False))
        entries = pc.list_flatten(v)
        found, counts = [], pc.struct_field(entries, 1).to_numpy(zero_copy_only=False)
        for (_, size), name in zip(side, names, strict=True):
            p = np.tile(frequencies(np.zeros(len(size), np.int64), np.maximum(size, 1)), (len(v), 1))
            at = pc.fill_null(pc.index_in(pc.struct_field(entries, 0).cast(pa.string()), value_set=name), -1).to_numpy(zero_copy_only=False)
            here = at >= 0
            p[row[here], at[here]] = frequencies(counts[here], size[at[here]])
            found.append(p)
        total += times @ np.abs(found[0][:, one] - found[1][:, two])
    return pa.table({"lang": pa.array([key[0].as_py()] * len(one), pa.string()), "one": names[0].take(pa.array(one)), "two": names[1].take(pa.array(two)), "value": pa.array(total)})


def kept_terms(tally: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, v): the terms in at least `least` documents of a language, with their counts by source, sorted."""
    counts = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("v")
    return tally.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), counts).where(F.col("docs") >= least).select("lang", "term", "v")


def group_sizes(tally: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, size, all_size): N + SMOOTH * V of each group and of its language."""
    entries = kept.select("lang", F.explode("v").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("words"))
    groups = tally.where("term = ''").select("lang", "source").join(entries, ["lang", "source"], "left").select("lang", "source", F.coalesce("words", F.lit(0)).alias("words"))
    langs = groups.groupBy("lang").agg(F.sum("words").alias("lang_words")).join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    extra = F.coalesce("terms", F.lit(0)) * SMOOTH
    return groups.join(langs, "lang").select("lang", "source", (F.col("words") + extra).alias("size"), (F.col("lang_words") + extra).alias("all_size"))


def pairs(kept: DataFrame, sizes: DataFrame, tile: int = TILE, slice_of: int = VECTORS) -> DataFrame:
    """(lang, one, two, value): the divergence of every two sources of a language, each pair once."""
    distinct = stored(kept.groupBy("lang", "v").agg(F.count("*").alias("m")), "vectors")
    most = sizes.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks, slices = -(-most // tile), max(1, -(-distinct.count() // slice_of))
    dealt = F.pmod(F.xxhash64("source"), F.lit(blocks))
    held = sizes.groupBy("lang", dealt.alias("block")).agg(F.array_sort(F.collect_list(F.struct("source", "size"))).alias("s"))
    side = lambda s: held.select("lang", F.col("block").alias(s), F.col("s.source").alias(f"{s}_source"), F.col("s.size").alias(f"{s}_size"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    tiles = side("a").join(side("b"), "lang").where("a <= b").select("*", every)
    of = lambda e: F.pmod(F.xxhash64(e.source), F.lit(blocks))
    cut_to = F.filter("v", lambda e: of(e).isin(F.col("a"), F.col("b")) if blocks > 1 else F.lit(True))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sent = distinct.select("lang", "v", "m", F.pmod(F.xxhash64("v"), F.lit(slices)).cast("int").alias("slice"), pieces.alias("a")).select("*", pieces.alias("b")).where("a <= b")
    sent = sent.select("lang", "a", "b", "slice", cut_to.alias("v"), "m")
    keys = ["lang", "a", "b", "slice"]
    parts = sent.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(_guarded, "lang string, one string, two string, value long")
    return parts.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))


def _guarded(key: tuple, vectors: pa.Table, tile: pa.Table) -> pa.Table:
    """A language may have no source in one of the blocks; then it has no such tile."""
    if not tile.num_rows:
        return pa.table({c: pa.array([], pa.int64() if c == "value" else pa.string()) for c in ("lang", "one", "two", "value")})
    return _evaluated(key, vectors, tile)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, tile: int = TILE, slice_of: int = VECTORS) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by divergence, and the `top` terms that a source uses more than its language."""
    tally = stored(tallies(docs), "tallies")
    kept = stored(kept_terms(tally, least), "kept-terms")
    sizes = stored(group_sizes(tally, kept), "group-sizes")
    found = pairs(kept, sizes, tile, slice_of)
    both = found.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("p"), "value")
    both = both.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    all_words = F.aggregate("v", F.lit(0).cast("long"), lambda s, e: s + e.n)
    each = kept.select("lang", "term", all_words.alias("all_n"), F.explode("v").alias("e")).select("lang", "e.source", "term", "e.n", "all_n").join(sizes, ["lang", "source"])
    more = frequency(F.col("n"), F.col("size")) - frequency(F.col("all_n"), F.col("all_size"))
    own = each.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    ranked = lambda x: x.select("*", rank)
    return ranked(both).unionByName(ranked(own).where(F.col("rank") <= top))
