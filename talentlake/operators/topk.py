"""The best candidates of every criteria by weighted cosine, without scoring all pairs.

Candidates are dealt into blocks, criteria into blocks, and a task holds one of each. It keeps, per skill, the list of its
candidates in the order (profile size, newest, id): a small profile makes a shared weight count more, so good candidates
come first. For one criteria the lists of its skills are read in steps side by side (a threshold algorithm). Whoever
appears gets the exact score; whoever has not appeared yet lies behind the reading position of each list it is in, which
bounds its profile size from below and so its score from above. The criteria ends as soon as that bound cannot reach the
k-th best any more. A task returns at most k rows per criteria; no table of pairs exists.

Criteria with equal skills and weights are answered once. Of candidates with equal skills only the first k in the order
(newest, id) can be among the k best, so no others reach a block. What a block does thus follows the number of different
criteria and of different skill sets.

With few different required skills a block keeps a bit per candidate and skill instead of lists, in ranges of equal profile size.
A criteria then has few possible scores, one for each subset of its skills and each size; they are tried in descending order, and
who holds exactly that subset at that size comes from a few operations on whole words (``BitBlock``). This serves the counts of
scores above a limit, too.

Scores are compared as they are shown (percent, two decimals), then newest, then smallest id, and the bound takes these
ties into account, so the result is exact. Candidates without a shared weight score 0 and are left to the caller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_dp
from ..plans.ranking import first_of_equal, top_per_group
from ..plans.skew import maybe_broadcast
from ..session import cut_lineage

CANDIDATE_BLOCK, CRITERIA_BLOCK = 1 << 17, 1 << 12
BIT_CANDIDATES, BIT_CRITERIA = 1 << 19, 1 << 16
BIT_SKILLS = 4096  # different required skills up to which blocks hold bits
BIT_SCORES, BIT_SUBSETS = 1 << 14, 1 << 8  # possible scores of a criteria up to which they are tried one by one
STEP = 32
NEVER = -(1 << 63)


@lru_cache(1 << 16)
def percent(dot: int, size: int, square: int, digits: int = 2) -> float:
    """The cosine in percent as shown: half-up to nine, then to two (or ``digits``) decimals."""
    if not dot or not size or not square:
        return 0.0
    cosine = min(max(dot / (math.sqrt(size) * math.sqrt(square)), 0.0), 1.0)
    return float(Decimal(repr(cosine * 100)).quantize(Decimal("1e-9"), ROUND_HALF_UP).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


class Block:
    """Inverted lists over the candidates of one block."""

    def __init__(self, ids: np.ndarray, born: np.ndarray, sizes: np.ndarray, skills: list[np.ndarray]):
        order = np.lexsort((ids, -born, sizes))
        self.ids, self.born, self.sizes = ids[order], born[order], sizes[order].astype(np.int64)
        held = [skills[i] for i in order]
        lengths = np.array([len(s) for s in held], np.int64)
        words = np.concatenate(held) if lengths.sum() else np.zeros(0, object)
        codes, names = pd.factorize(words)
        owner = np.repeat(np.arange(len(order)), lengths)
        by_skill = np.argsort(codes, kind="stable")  # owners stay in order within a skill
        edges = np.searchsorted(codes[by_skill], np.arange(len(names) + 1))
        self.lists = {name: owner[by_skill[edges[k] : edges[k + 1]]] for k, name in enumerate(names)}
        # The next larger profile size behind each place, 0 at the end.
        larger = np.searchsorted(self.sizes, self.sizes, side="right")
        self.next_size = np.where(larger < len(self.sizes), self.sizes[np.minimum(larger, len(self.sizes) - 1)], 0) if len(order) else larger

    def best(self, skills: list[str], weights: list[int], square: int, k: int, digits: int = 2) -> tuple[list[tuple[float, int, int]], int]:
        """The k best as (percent, place) keys in order, and how many candidates were scored."""
        lists = [(self.lists[s], w) for s, w in zip(skills, weights) if w > 0 and s in self.lists]
        seen = np.zeros(len(self.ids), bool)
        top: list[tuple[float, int, int, int]] = []  # (percent, newest, -id, place), best first
        at, step, root = [0] * len(lists), STEP, math.sqrt(square)
        while True:
            read = np.unique(np.concatenate([own[p : p + step] for (own, _), p in zip(lists, at)])) if lists else np.zeros(0, np.int64)
            fresh = read[~seen[read]]
            seen[fresh] = True
            dots = np.zeros(len(fresh), np.int64)
            for own, w in lists:
                place = np.searchsorted(own, fresh)
                dots += w * (own[np.minimum(place, len(own) - 1)] == fresh)
            rough = dots / (np.sqrt(self.sizes[fresh]) * root) * 100
            # Only what may enter the top is scored to the digit.
            least = top[-1][0] if len(top) == k else -np.partition(-rough, k - 1)[k - 1] if len(rough) > k else 0.0
            may = np.flatnonzero(rough >= least - 0.01)
            if len(may) > 4 * k:  # ties: of equal dot and size the first places are the newest
                order = np.lexsort((fresh[may], self.sizes[fresh[may]], dots[may]))
                may = may[order]
                kind = np.flatnonzero(np.concatenate([[True], (np.diff(dots[may]) != 0) | (np.diff(self.sizes[fresh[may]]) != 0)]))
                may = may[np.arange(len(may)) - np.repeat(kind, np.diff(np.append(kind, len(may)))) < k]
            for i, dot in zip(fresh[may].tolist(), dots[may].tolist()):
                top.append((percent(dot, int(self.sizes[i]), square, digits), int(self.born[i]), -int(self.ids[i]), i))
            top = sorted(top, reverse=True)[:k]
            at = [min(p + step, len(own)) for (own, _), p in zip(lists, at)]
            step *= 2
            if self.ended(lists, at, top, square, k, digits):
                return top, int(seen.sum())

    def ended(self, lists: list, at: list[int], top: list, square: int, k: int, digits: int = 2) -> bool:
        """Whether no unseen candidate can enter the top."""
        ahead = sorted((int(own[p]), w) for (own, w), p in zip(lists, at) if p < len(own))
        if not ahead:
            return True
        if len(top) < k:
            return False
        last = top[-1][:3]
        weights: list[int] = []
        for place, w in ahead:  # an unseen candidate that is only in the lists up to here lies at this place or behind it
            weights = sorted([*weights, w], reverse=True)
            size, larger = int(self.sizes[place]), int(self.next_size[place])
            total = 0
            for m, weight in enumerate(weights, 1):
                total += weight
                if m <= size and (percent(total, size, square, digits), int(self.born[place]), -int(self.ids[place])) >= last:
                    return False
                if larger and percent(total, max(larger, m), square, digits) >= last[0]:
                    return False
        return True


@lru_cache(32)
def subsets(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The subsets of n skills but the empty one, as rows of 0 and 1, and their sizes."""
    rows = (np.arange(1, 1 << n)[:, None] >> np.arange(n)) & 1
    return rows, rows.sum(1)


class BitBlock:
    """Candidates of one block as bits per skill, in the order (profile size, newest, id); each size starts a new word.

    ``codes`` holds the skills of all candidates as numbers, ``lengths`` of them for each."""

    def __init__(self, ids: np.ndarray, born: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
        order = np.lexsort((ids, -born, sizes))
        self.sizes, first, counts = np.unique(sizes[order], return_index=True, return_counts=True)
        words = -(-counts // 64)
        self.edges = np.concatenate([[0], np.cumsum(words)])
        bit = np.empty(len(ids), np.int64)  # of each candidate
        bit[order] = np.arange(len(ids)) - np.repeat(first, counts) + np.repeat(self.edges[:-1] * 64, counts)
        self.ids, self.born = np.zeros(self.edges[-1] * 64, ids.dtype), np.zeros(self.edges[-1] * 64, np.int64)
        self.ids[bit], self.born[bit] = ids, born
        by_code = np.argsort(codes, kind="stable")
        held = np.repeat(bit, lengths)[by_code]
        names, at = np.unique(codes[by_code], return_index=True)
        self.bits = {}
        for name, a, b in zip(names.tolist(), at, np.append(at[1:], len(codes))):
            mark = np.zeros(self.edges[-1] * 64, bool)
            mark[held[a:b]] = True
            self.bits[name] = np.packbits(mark, bitorder="little").view(np.uint64)

    def asked(self, codes: list[int], weights: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
        """Bits and weights of the skills that someone holds; a skill named twice counts with both weights."""
        total: dict[int, int] = {}
        for code, weight in zip(codes, weights):
            if weight > 0 and code in self.bits:
                total[code] = total.get(code, 0) + int(weight)
        return [self.bits[c] for c in total], np.array(list(total.values()), np.int64)

    def too_many(self, n: int) -> bool:
        return 1 << n > BIT_SUBSETS or len(self.sizes) << n > BIT_SCORES

    def scores(self, weights: np.ndarray, square: int) -> tuple[np.ndarray, np.ndarray]:
        """Dots of the subsets of the weights and their unrounded percents at each size; -1 where a size is too small."""
        rows, n = subsets(len(weights))
        dots = rows @ weights
        rough = dots[:, None] / (np.sqrt(self.sizes)[None, :] * math.sqrt(square)) * 100
        return dots, np.where(n[:, None] <= self.sizes[None, :], rough, -1.0)

    def best(self, codes: list[int], weights: list[int], square: int, k: int, digits: int = 2) -> list[tuple[float, int, int]]:
        """The k best as (percent, born, id)."""
        bits, weights = self.asked(codes, weights)
        if not bits:
            return []
        if self.too_many(len(bits)):
            return self.best_of_all(bits, weights, square, k, digits)
        dots, rough = self.scores(weights, square)
        kinds, top = len(self.sizes), []
        flat = rough.ravel()
        for at in np.argsort(-flat, kind="stable").tolist():
            if flat[at] < 0 or (len(top) == k and flat[at] < top[-1][0] - 0.01):
                break
            subset, kind = at // kinds + 1, at % kinds
            a, b = self.edges[kind], self.edges[kind + 1]
            own = None
            for j, held in enumerate(bits):
                if subset >> j & 1:
                    own = held[a:b] if own is None else own & held[a:b]
            if not own.any():
                continue
            for j, held in enumerate(bits):
                if not subset >> j & 1:
                    own = own & ~held[a:b]
            found = np.flatnonzero(own)[:k]  # words; the first k hold the first k bits
            if not len(found):
                continue
            where, bit = np.nonzero(np.unpackbits(own[found].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            place = ((a + found)[where] * 64 + bit)[:k]
            value = percent(int(dots[subset - 1]), int(self.sizes[kind]), square, digits)
            top += [(value, born, -who) for born, who in zip(self.born[place].tolist(), self.ids[place].tolist())]
            top = sorted(top, reverse=True)[:k]
        return [(value, born, -who) for value, born, who in top]

    def dots_of_all(self, bits: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places with a dot above 0, and their dots."""
        dots = np.zeros(self.edges[-1] * 64, np.int64)
        for held, weight in zip(bits, weights):
            dots += weight * np.unpackbits(held.view(np.uint8), bitorder="little")
        place = np.flatnonzero(dots)
        return place, dots[place]

    def best_of_all(self, bits: list[np.ndarray], weights: np.ndarray, square: int, k: int, digits: int) -> list[tuple[float, int, int]]:
        """``best`` for criteria with too many possible scores: all dots, and the scores of what may enter the top."""
        place, dots = self.dots_of_all(bits, weights)
        size = np.repeat(self.sizes, np.diff(self.edges))[place >> 6]
        rough = dots / (np.sqrt(size) * math.sqrt(square)) * 100
        may = np.flatnonzero(rough >= -np.partition(-rough, k - 1)[k - 1] - 0.01) if len(rough) > k else np.arange(len(rough))
        own = zip(place[may].tolist(), dots[may].tolist(), size[may].tolist())
        top = sorted(((percent(d, z, square, digits), int(self.born[p]), -int(self.ids[p])) for p, d, z in own), reverse=True)[:k]
        return [(value, born, -who) for value, born, who in top]

    def counts(self, codes: list[int], weights: list[int], square: int, limits: list[float], digits: int = 2) -> list[int]:
        """How many candidates reach each limit (shares of 1, all above 0), as shown."""
        bits, weights = self.asked(codes, weights)
        if not bits:
            return [0] * len(limits)
        if self.too_many(len(bits)):
            place, dots = self.dots_of_all(bits, weights)
            size = np.repeat(self.sizes, np.diff(self.edges))[place >> 6]
            kinds, many = np.unique(np.stack([dots, size], 1), axis=0, return_counts=True)
            dots, size = kinds.T
            rough = dots / (np.sqrt(size) * math.sqrt(square)) * 100
        else:
            each, rough = self.scores(weights, square)
            reach = np.flatnonzero(rough.max(0) >= min(limits) * 100 - 0.01)  # sizes
            if not len(reach):
                return [0] * len(limits)
            kinds = int(reach[-1]) + 1
            end, starts = self.edges[kinds], self.edges[:kinds]
            shared: list[np.ndarray | None] = [None] * (1 << len(bits))
            many = np.zeros((1 << len(bits), kinds), np.int64)  # who holds at least the subset
            for subset in range(1, 1 << len(bits)):
                low = (subset & -subset).bit_length() - 1
                rest = shared[subset & (subset - 1)]
                shared[subset] = bits[low][:end] if rest is None else rest & bits[low][:end]
                many[subset] = np.add.reduceat(np.bitwise_count(shared[subset]), starts, dtype=np.int64)
            for j in range(len(bits)):  # then who holds exactly the subset
                without = np.flatnonzero(~(np.arange(1 << len(bits)) >> j) & 1)
                many[without] -= many[without | 1 << j]
            subset, kind = np.nonzero(many[1:])
            many, dots, size, rough = many[1:][subset, kind], each[subset], self.sizes[kind], rough[subset, kind]
        out = []
        for limit in limits:
            sure = rough >= limit * 100 + 0.01
            open_ = np.flatnonzero(~sure & (rough >= limit * 100 - 0.01))
            out.append(int(many[sure].sum()) + sum(int(many[i]) for i in open_ if percent(int(dots[i]), int(size[i]), square, digits) / 100 >= limit))
        return out


def coded(rows: DataFrame, names: list[str]) -> DataFrame:
    """``skills`` as the numbers of their names; skills of other names are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(names)
    fields = ", ".join(f"`{n}` {'array<int>' if n == 'skills' else t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            at = batch.schema.get_field_index("skills")
            held = batch.column(at)
            codes = pa.compute.index_in(held.flatten().cast(pa.string()), known)
            ends = np.concatenate([[0], np.cumsum(pa.compute.is_valid(codes).to_numpy(zero_copy_only=False))])
            offsets = held.offsets.to_numpy() - held.offsets[0].as_py()
            lists = pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), codes.drop_null().cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, fields)


def required_names(need: DataFrame) -> list[str] | None:
    """The different skills of the criteria, None when there are more than BIT_SKILLS or nameless ones."""
    found = [r["skill"] for r in need.select(F.explode("skills").alias("skill")).distinct().limit(BIT_SKILLS + 1).collect()]
    return None if len(found) > BIT_SKILLS or None in found else sorted(found)


def met_blocks(people: DataFrame, jobs: DataFrame, candidate_block: int, criteria_block: int):
    """Blocks of candidates and of criteria, every one of each side with every one of the other, as a co-grouped pair."""
    parallel = people.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-people.count() // candidate_block))
    parts = max(1, -(-jobs.count() // criteria_block), -(-2 * parallel // blocks))
    left = people.withColumns({
        "_c": F.pmod(F.xxhash64("candidate_id"), F.lit(blocks)), "_j": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))})
    right = jobs.withColumns({
        "_j": F.pmod(F.xxhash64("criteria_id"), F.lit(parts)), "_c": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))})
    return left.groupBy("_c", "_j").cogroup(right.groupBy("_c", "_j"))


def bit_block(people: pa.Table) -> BitBlock:
    skills = people.column("skills").combine_chunks()
    number = lambda c: people.column(c).to_numpy()
    return BitBlock(number("candidate_id"), number("born"), number("size").astype(np.int64), pa.compute.list_value_length(skills).to_numpy(zero_copy_only=False), skills.flatten().to_numpy())


def jobs_of(jobs: pa.Table) -> Iterator[tuple]:
    return zip(*(jobs.column(c).to_pylist() for c in ("criteria_id", "skills", "weights", "square")))


def counts_above(held: DataFrame, need: DataFrame, limits: list[float], digits: int = 2) -> DataFrame | None:
    """(criteria_id, reached): for each limit (a share of 1, above 0) how many candidates have a score of at least that, with
    the sides of ``top_scored``; criteria that nobody overlaps may be missing. None when there are too many different skills."""
    need = cut_lineage(need.filter("square > 0").select("criteria_id", "skills", "weights", "square"))
    names = required_names(need)
    if names is None:
        return None
    people = cut_lineage(coded(held.filter("size > 0").select("candidate_id", F.lit(0).cast("long").alias("born"), "size", "skills"), names))
    asked, alike = (cut_lineage(x) for x in first_of_equal(need, ["skills", "weights", "square"], "criteria_id"))
    kind = dict(need.dtypes)["criteria_id"]

    def run(people: pa.Table, jobs: pa.Table) -> pa.Table:
        block = bit_block(people) if people.num_rows and jobs.num_rows else None
        found = [(who, block.counts(skills, weights, square, limits, digits)) for who, skills, weights, square in jobs_of(jobs)] if block else []
        return pa.table({"criteria_id": pa.array([f[0] for f in found], jobs.schema.field("criteria_id").type), "reached": pa.array([f[1] for f in found], pa.list_(pa.int64()))})

    found = met_blocks(people, coded(asked, names), BIT_CANDIDATES, BIT_CRITERIA).applyInArrow(run, f"criteria_id {kind}, reached array<long>")
    total = found.groupBy("criteria_id").agg(F.array(*[F.sum(F.get("reached", F.lit(i))) for i in range(len(limits))]).alias("reached"))
    return alike.join(total.withColumnRenamed("criteria_id", "_asked"), "_asked").select("criteria_id", "reached")


def top_scored(held: DataFrame, need: DataFrame, k: int, candidate_block: int | None = None, criteria_block: int | None = None, digits: int = 2, bits: bool = True) -> DataFrame:
    """(criteria_id, candidate_id, score_pct, created_at) of the k best per criteria with a score above 0.

    ``held``: candidate_id (integer), created_at, size, skills (array). ``need``: criteria_id, skills, weights (arrays of the
    skills that count), square. ``bits`` lets few different skills be held as bits.
    """
    born = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(NEVER + 1)).alias("born")
    people = held.filter("size > 0").select("candidate_id", born, "size", F.array_sort("skills").alias("skills"))
    first = cut_lineage(top_per_group(people, ["skills", "size"], [F.desc("born"), F.asc("candidate_id")], k).drop("rank"))
    asked, alike = (cut_lineage(x) for x in first_of_equal(
        need.filter("square > 0").select("criteria_id", "skills", "weights", "square"), ["skills", "weights", "square"], "criteria_id"))
    kinds = {n: t for n, t in [*held.dtypes, *need.dtypes]}
    schema = f"criteria_id {kinds['criteria_id']}, candidate_id {kinds['candidate_id']}, score_pct double, born long"

    def run(people: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(people) and len(jobs):
            block = Block(people["candidate_id"].to_numpy(), people["born"].to_numpy(), people["size"].to_numpy(), list(people["skills"]))
            for job in jobs.itertuples():
                found, _ = block.best(list(job.skills), [int(w) for w in job.weights], int(job.square), k, digits)
                rows += [(job.criteria_id, -key, score, born) for score, born, key, _ in found if score > 0]
        return pd.DataFrame(rows, columns=["criteria_id", "candidate_id", "score_pct", "born"])

    def run_bits(people: pa.Table, jobs: pa.Table) -> pa.Table:
        block = bit_block(people) if people.num_rows and jobs.num_rows else None
        rows = [(who, key, score, born) for who, skills, weights, square in jobs_of(jobs) for score, born, key in block.best(skills, weights, square, k, digits) if score > 0] if block else []
        types = [jobs.schema.field("criteria_id").type, people.schema.field("candidate_id").type, pa.float64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["criteria_id", "candidate_id", "score_pct", "born"])

    names = required_names(asked) if bits else None
    if names is None:
        partial = met_blocks(first, asked, candidate_block or CANDIDATE_BLOCK, criteria_block or CRITERIA_BLOCK).applyInPandas(run, schema)
    else:
        partial = met_blocks(cut_lineage(coded(first, names)), coded(asked, names), candidate_block or BIT_CANDIDATES, criteria_block or BIT_CRITERIA).applyInArrow(run_bits, schema)
    top = top_per_group(partial, ["criteria_id"], [F.desc("score_pct"), F.desc("born"), F.asc("candidate_id")], k)
    return alike.join(top.withColumnRenamed("criteria_id", "_asked"), "_asked").select("criteria_id", "candidate_id", "score_pct")


def matching_sides(candidate_skills: DataFrame, candidates: DataFrame, criteria_skills: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles and criteria as ``top_scored`` and ``pair_details`` take them; names are normalised by the caller."""
    from .matching import clamp_weight

    known = maybe_broadcast(universe.select("skill").distinct().withColumn("_in", F.lit(True)))
    marked = lambda df: df.join(known, "skill", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    people = marked(candidate_skills.select("candidate_id", "skill").distinct()).groupBy("candidate_id").agg(
        F.collect_list("skill").alias("skills"), F.sum(F.col("_in").cast("int")).alias("size"))
    held = cut_lineage(people.join(candidates.select("candidate_id", "created_at"), "candidate_id"))
    rows = marked(criteria_skills.select("criteria_id", "skill", clamp_weight("weight").alias("weight")))
    items = F.struct("skill", "weight", "_in")
    grouped = rows.groupBy("criteria_id").agg(
        F.array_sort(F.collect_list(items)).alias("items"), F.sum(F.when(F.col("_in"), F.col("weight") * F.col("weight")).otherwise(0)).alias("square"),
        F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("n_required"))
    counted = F.filter("items", lambda s: s["_in"])
    need = grouped.select("criteria_id", F.transform(counted, lambda s: s["skill"]).alias("skills"), F.transform(counted, lambda s: s["weight"]).alias("weights"),
                          "square", "items", "total_weight", "n_required")
    return held, cut_lineage(need)


def pair_details(pairs: DataFrame, held: DataFrame, need: DataFrame) -> DataFrame:
    """similarity, coverage, matched and required counts, weights and skills of the given pairs (k per criteria)."""
    from .matching import coverage_of

    rows = pairs.join(need.select("criteria_id", "items", "square", "total_weight", "n_required"), "criteria_id").join(
        held.select("candidate_id", F.col("skills").alias("_held"), "size"), "candidate_id", "left")
    hits = F.filter("items", lambda s: F.array_contains(F.coalesce("_held", F.array().cast("array<string>")), s["skill"]))
    add = lambda items, value: F.aggregate(items, F.lit(0).cast("long"), lambda a, s: a + value(s))
    rows = rows.withColumn("_hits", hits).withColumns({
        "_dot": add("_hits", lambda s: F.when(s["_in"], s["weight"]).otherwise(0)), "matched_weight": add("_hits", lambda s: s["weight"]),
        "n_matched": F.size("_hits").cast("long"), "matched_skills": F.array_sort(F.transform("_hits", lambda s: s["skill"]))})
    norm = F.sqrt(F.col("size")) * F.sqrt(F.col("square"))
    cosine = F.when(norm > 0, F.col("_dot") / norm).otherwise(0.0)
    rows = rows.withColumns({
        "similarity": F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)),
        "coverage_pct": round_dp(coverage_of(F.col("matched_weight"), F.col("total_weight")), 2)})
    return rows.withColumn("score_pct", round_dp(F.col("similarity") * 100, 2)).drop("items", "square", "_held", "size", "_hits", "_dot")


def top_matches(
    candidate_skills: DataFrame, candidates: DataFrame, criteria_skills: DataFrame, universe: DataFrame, k: int, criteria: DataFrame | None = None,
) -> DataFrame:
    """The k best candidates per criteria with score, coverage, matched skills and rank. ``candidates`` are those who take
    part. With ``criteria`` the ranking is complete: criteria with fewer positive scores go on with score 0, newest first."""
    from .matching import named_skills, rank_top

    held, need = matching_sides(named_skills(candidate_skills, "candidate_id"), candidates, named_skills(criteria_skills, "criteria_id", "weight"), universe)
    ranked = rank_top(cut_lineage(top_scored(held, need, k)), candidates, k, criteria)
    shown = cut_lineage(ranked.select("criteria_id", "candidate_id", "created_at", "full_name", "rank"))
    if criteria is None:
        return pair_details(shown, held, need)
    details = pair_details(shown, held, need)
    bare = shown.join(need.select("criteria_id"), "criteria_id", "left_anti")  # criteria without skills
    return details.unionByName(bare.withColumns({c: F.lit(0).cast(t) for c, t in details.dtypes if c not in shown.columns and not t.startswith("array")}), allowMissingColumns=True).withColumn(
        "matched_skills", F.coalesce("matched_skills", F.array().cast("array<string>")))
