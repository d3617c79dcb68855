"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph pieces.

Texts of every length are cut by one rule: at line ends, and in a line after 20 units,
a unit being up to eight characters of a word and the blanks behind them. From the
twelfth unit on a piece already ends where the end of a sentence, a comma, a colon or one of three vowels
stands before a blank, so that pieces meet again behind an insertion. A piece's digest is its 64-bit hash.

A sketch has three rows of eight cells; a digest goes into one cell of each row, and
a cell keeps how many came, and the exclusive-or of the digests and of their check
hashes. Sketches subtract cell by cell, and what two versions share cancels. Cells
left with one digest give it away; it is taken out of its other cells, and so on,
until nothing is left: these are the differing digests. A text's fingerprint is
its sketch. The fingerprints of two texts are subtracted first. If something is
left of them they were too small, and larger sketches are peeled: as many tables as the
numbers of digests call for, then four in place of each one that fails. Every
retry deals by two other bits of the digests, 32 times if need be, which tells any two
digests apart; so the retries end with all differences recovered.

All of it is expressions over a row's arrays. The next document is found in a window
over ranges of ids, whose bounds come from a narrow pass over the ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseframe.llm.common import parts_for, text_of

#: Documents per range of ids, ranges at most, and rounds of peeling.
RANGE_ROWS, MAX_RANGES, ROUNDS = 3_000, 100_000, 8
#: Rows of a table and bits that a row looks at; 2 ** BITS cells make a row.
ROWS, BITS = 3, 3
#: Expected differences per table of larger sketches, and retries: one for each two bits of a digest.
LOAD, RETRIES = 11, 32
#: The pieces of a line.
PIECE = r"(?:\S{1,8}+\s*+){12,19}?(?<=[.!?,:aeo] )|(?:\S{1,8}+\s*+){1,20}"


def digests(text: Column) -> Column:
    """Distinct digests of the pieces of a text; blanks alone are no piece."""
    pieces = F.flatten(F.transform(F.split(text, "\n"), lambda p: F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


_NONE = "cast(array() AS array<bigint>)"
_WHOLE = "forall({0}.t, c -> c.n = 0 AND c.k = 0)"


def _cells(first: int | str, cell: str) -> str:
    """SQL: the cells of a table by ``cell``, which has {m} for the bits a cell looks at and {v} for their value.

    The rows look at their bits one after the other, from the bit ``first`` on, which may be an expression.
    """
    rows = [BITS * r for r in range(ROWS)]
    if isinstance(first, int):
        masks = [((2 ** BITS - 1) << at, [v << at for v in range(2 ** BITS)]) for at in (first + r for r in rows)]
        return "concat(" + ", ".join(f"transform(array({', '.join(f'{v}L' for v in values)}), v -> {cell.format(m=f'{m}L', v='v')})" for m, values in masks) + ")"
    pairs = ", ".join(f"named_struct('m', shiftleft({2 ** BITS - 1}L, {first} + {r}), 'v', shiftleft({v}L, {first} + {r}))" for r in rows for v in range(2 ** BITS))
    return f"transform(array({pairs}), z -> {cell.format(m='z.m', v='z.v')})"


def _filled(count: str, digests: str) -> str:
    """SQL: a cell with these digests."""
    return (f"named_struct('n', {count}, 'k', aggregate({digests}, 0L, (s, x) -> s ^ x), "
            f"'c', aggregate({digests}, 0L, (s, x) -> s ^ xxhash64(x)), 'm', {{m}}, 'v', {{v}})")


def _here(digests: str) -> str:
    """SQL: the digests that go into a cell."""
    return f"filter({digests}, x -> (x & {{m}}) = {{v}})"


def _difference(a: str, b: str, first: int | str) -> str:
    """SQL: the sketch of digests ``a`` less that of ``b``, filled at once."""
    both = f"named_struct('a', {_here(a)}, 'b', {_here(b)})"
    return _cells(first, f"element_at(transform(array({both}), y -> {_filled('size(y.a) - size(y.b)', 'concat(y.a, y.b)')}), 1)")


def _subtracted(a: str, b: str) -> str:
    """SQL: sketch ``a`` less sketch ``b``, cell by cell."""
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'c', p.c ^ q.c, 'm', p.m, 'v', p.v))"


def _peeled(table: str) -> str:
    """SQL: (t, a, b, go): what is left of a difference, and the digests recovered on each side."""
    pure = "array_distinct(transform(filter(s.t, c -> abs(c.n) = 1 AND xxhash64(c.k) = c.c), c -> named_struct('k', c.k, 'n', c.n)))"
    without = ("transform(s.t, c -> aggregate(filter(p, q -> (q.k & c.m) = c.v), c, (u, q) -> "
               "named_struct('n', u.n - q.n, 'k', u.k ^ q.k, 'c', u.c ^ xxhash64(q.k), 'm', u.m, 'v', u.v)))")
    side = lambda n: f"transform(filter(p, q -> q.n = {n}), q -> q.k)"
    step = (f"element_at(transform(array({pure}), p -> if(size(p) = 0, named_struct('t', s.t, 'a', s.a, 'b', s.b, 'go', false), "
            f"named_struct('t', {without}, 'a', concat(s.a, {side(1)}), 'b', concat(s.b, {side(-1)}), 'go', true))), 1)")
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('t', {table}, 'a', {_NONE}, 'b', {_NONE}, 'go', true), "
            f"(s, r) -> if(s.go, {step}, s))")


def _tried(g: str, first: int | str) -> str:
    """SQL: (a, b, left): the differences of a group of digests, or the group itself in ``left`` if its tables do not peel."""
    found = _peeled(_difference(f"{g}.a", f"{g}.b", first))
    nothing = "cast(array() AS array<struct<a: array<bigint>, b: array<bigint>>>)"
    return (f"element_at(transform(array({found}), f -> if({_WHOLE.format('f')}, named_struct('a', f.a, 'b', f.b, 'left', {nothing}), "
            f"named_struct('a', {_NONE}, 'b', {_NONE}, 'left', array({g})))), 1)")


def _together(groups: str, a: str = _NONE, b: str = _NONE) -> str:
    """SQL: the results of groups as one, behind what was found before."""
    flat = lambda f: f"flatten(transform(e, z -> z.{f}))"
    return (f"element_at(transform(array({groups}), e -> named_struct('a', concat({a}, {flat('a')}), "
            f"'b', concat({b}, {flat('b')}), 'left', {flat('left')})), 1)")


def _dealt(a: str, b: str, mask: str, value: str) -> str:
    """SQL: the digests of both sides whose masked bits have the value."""
    side = lambda x: f"filter({x}, y -> (y & {mask}) = {value})"
    return f"named_struct('a', {side(a)}, 'b', {side(b)})"


def _larger(a: str, b: str) -> str:
    """SQL: the differences by a sketch of a table per value of the bits in ``_high`` and ``_low``, and by four for each that fails, until none does.

    Digests are dealt to the tables in two steps, so that a long text costs little more than its length.
    """
    groups = (f"flatten(transform(sequence(0L, _high, {1 << 38}L), h -> element_at(transform(array({_dealt(a, b, '_high', 'h')}), "
              f"w -> transform(sequence(0L, _low, {1 << 46}L), l -> {_dealt('w.a', 'w.b', '_low', 'l')})), 1)))")
    first = _together(f"transform({groups}, g -> {_tried('g', ROWS * BITS)})")
    at = "(18 + 8 * i + 2 * (i div 8)) % 64"  # all pairs of bits in 32 steps, and cells by other bits than before for the first few
    quarters = f"flatten(transform(t.left, g -> transform(array(0L, 1L, 2L, 3L), u -> {_dealt('g.a', 'g.b', f'shiftleft(3L, cast({at} AS int))', f'shiftleft(u, cast({at} AS int))')})))"
    again = _together(f"transform({quarters}, g -> {_tried('g', f'cast({at} + 2 AS int)')})", "t.a", "t.b")
    return f"aggregate(sequence(0, {RETRIES - 1}), {first}, (t, i) -> if(size(t.left) = 0, t, {again}))"


def sketch(digests: str) -> Column:
    """The fingerprint of a column of digests, as cells."""
    return F.expr(_cells(0, f"element_at(transform(array({_here(digests)}), y -> {_filled('size(y)', 'y')}), 1)"))


def compare(df: DataFrame, a: str, b: str, sketch_a: str, sketch_b: str, expected: str, to: str) -> DataFrame:
    """``df`` with the column ``to``: (only_a, only_b, likeness, larger) for two columns of digests and their sketches.

    The sketches are subtracted and peeled. Where they were too small, ``larger`` is true and the
    differences come from sketches with a table per ``LOAD`` of the ``expected`` differences, and their
    retries. Likeness is the share of distinct pieces in both texts among those in either; two texts
    without pieces are alike.
    """
    groups = f"cast(pow(2, ceil(log2(greatest(1, ({expected}) / {LOAD})))) AS bigint)"
    high = f"cast(pow(2, floor(log2({groups}) / 2)) AS bigint)"
    out = df.withColumn("_high", F.expr(f"shiftleft({high} - 1, 38)")).withColumn("_low", F.expr(f"shiftleft({groups} div {high} - 1, 46)"))
    out = out.withColumn("_found", F.expr(
        f"element_at(transform(array({_peeled(_subtracted(sketch_a, sketch_b))}), f -> if({_WHOLE.format('f')}, "
        f"named_struct('a', f.a, 'b', f.b, 'larger', false), element_at(transform(array({_larger(a, b)}), "
        "t -> named_struct('a', t.a, 'b', t.b, 'larger', true)), 1))), 1)"))
    either = F.size(a) + F.size("_found.b")
    likeness = F.when(either == 0, F.lit(1.0)).otherwise(((F.size(a) - F.size("_found.a")) / either).cast("double"))
    return out.withColumn(to, F.struct(F.col("_found.a").alias("only_a"), F.col("_found.b").alias("only_b"), likeness.alias("likeness"),
                                       F.col("_found.larger").alias("larger"))).drop("_found", "_high", "_low")


def as_text(cells: str) -> Column:
    """The fingerprint as text: per cell the count, the digests and the checks."""
    return F.expr(f"array_join(transform({cells}, c -> concat(hex(c.n), '.', hex(c.k), '.', hex(c.c))), ' ')")


# -- the next document -----------------------------------------------------------------

def _bounds(docs: DataFrame, rows: int) -> list[int]:
    """Smallest ids of ranges with about ``rows`` documents each, ascending."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    n = min(MAX_RANGES, parts_for(ids.count(), rows))
    dealt = ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
    return sorted({r.low for r in dealt.select("low").collect()})  # one number per range


def _range_of(bounds: list[int]) -> Column:
    """Number of bounds at or below the id, less one, found in two steps; null ids are in range -1."""
    step = max(1, math.isqrt(len(bounds)))
    fine, coarse = (F.array(*[F.lit(b) for b in x]) for x in (bounds, bounds[::step])) if bounds else (None, None)
    if not bounds:
        return F.lit(-1)
    block = F.size(F.filter(coarse, lambda b: b <= F.col("doc_id"))) - 1
    within = F.transform(F.array(block), lambda k: k * step + F.size(F.filter(F.slice(fine, k * step + 1, step), lambda b: b <= F.col("doc_id"))) - 1)
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.greatest(within[0], F.lit(0)))


def with_next(docs: DataFrame, carried: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` with next_<column>: the columns of the next document by descending id, after the last those of the first.

    Null ids come last; rows of one id go by their text's hash.
    """
    bounds = _bounds(docs, range_rows)
    placed = docs.withColumn("_range", _range_of(bounds)).withColumn("_tie", F.xxhash64("text"))
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), "_tie")
    value = F.struct(*carried)
    ahead = placed.withColumn("_next", F.lead(value).over(order)).withColumn("_end", F.lead(F.lit(1)).over(order).isNull())
    # The first document of each range, for the last one of the range before it.
    firsts = placed.groupBy("_range").agg(F.max("doc_id").alias("_first"))
    # One id per range, at most MAX_RANGES of them, is small enough to be sent along.
    heads = placed.select("_range", "doc_id", "_tie", value.alias("_head")).join(
        F.broadcast(firsts.select(F.col("_range").alias("_r"), "_first")), (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    heads = heads.groupBy("_range").agg(F.min_by("_head", "_tie").alias("_head"))
    nulls = not docs.where("doc_id IS NULL").isEmpty()
    top, bottom = len(bounds) - 1, -1 if nulls else 0
    before = F.when(F.col("_range") == top, bottom).otherwise(F.col("_range") + 1)
    heads = heads.select(before.alias("_h"), "_head", F.lit(True).alias("_e"))
    out = ahead.join(heads, (F.col("_range") == F.col("_h")) & (F.col("_end") == F.col("_e")), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[
        F.when(F.col("_end"), F.col(f"_head.{c}")).otherwise(F.col(f"_next.{c}")).alias(f"next_{c}") for c in carried])


def fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprint of every text and of its edited text, and what their subtraction recovers.

    The edited text has its last half replaced by the start of the next document.
    A null text is empty, an empty one has no pieces and an empty sketch. A
    single document is its own next one. ``edited`` and ``next`` hold the recovered
    digests of each side, the likeness, and whether larger sketches were needed.
    """
    text = text_of(docs)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn("d", digests(F.col("text"))).withColumn("sd", sketch("d"))
    rows = with_next(own, ["text", "d", "sd"], range_rows)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited_text", F.concat(F.left("text", n - half), F.left("next_text", half))).drop("text", "next_text")
    rows = rows.withColumn("e", digests(F.col("edited_text"))).withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text").withColumn("se", sketch("e"))
    rows = compare(rows, "d", "e", "sd", "se", "greatest(size(d), size(e))", "edited")
    rows = compare(rows, "d", "next_d", "sd", "next_sd", "size(d) + size(next_d)", "next")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text("sd").alias("fingerprint"),
                       as_text("se").alias("edited_fingerprint"), "edited", "next")


def report(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.col("edited.likeness").alias("near_edited"), F.col("next.likeness").alias("near_next"))
