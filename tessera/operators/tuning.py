"""Tuning of nets by a population: groups of members that restart, vary and form committees; a round judges all copies in one distributed product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rank import Net, compare, judged
from tessera.operators.staged import staged

#: Rounds of each phase: members start anew; vary their own best; their group's; the best of all; committees of the groups' best.
PHASES = {"restart": 6, "solo": 10, "group": 8, "all": 8, "combo": 6}
LARGEST = 1000


def sign_table(pairs: DataFrame) -> DataFrame:
    """signs (one byte for each feature) of pairs (left, right: arrays of numbers, the better candidate on the left), as a written table."""
    signs = F.zip_with("left", "right", lambda a, b: (compare(a, b) + 1).cast("string"))
    return staged(pairs.where("left is not null and right is not null").select(F.array_join(signs, "").cast("binary").alias("signs")), "signs")


def population_scores(table: DataFrame, committees: Sequence[Sequence[Net]]) -> DataFrame:
    """copy, right, total: how many rows of a sign table each committee (of one net or several) ranks right, by a majority of its nets.

    The nets go with the tasks (a population is small and of a known size); a task sends one row for each copy.
    """
    nets = [_plain(n) for c in committees for n in c]
    ends = np.cumsum([0, *map(len, committees)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, total = np.zeros(len(committees), np.int64), 0
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if not rows:
                continue
            signs = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1).astype(np.float64) - 49  # '0', '1', '2'
            good = judged(signs, nets) == -1
            total += len(rows)
            for c, (a, b) in enumerate(zip(ends, ends[1:])):
                right[c] += int((2 * good[a:b].sum(0) > b - a).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(committees)), pa.int32()), pa.array(right), pa.array([total] * len(committees), pa.int64())], ["copy", "right", "total"])

    return table.select("signs").mapInArrow(run, "copy int, right long, total long").groupBy("copy").agg(F.sum("right").alias("right"), F.sum("total").alias("total"))


def _plain(net: Net) -> Net | list[float]:
    """A linear net as its weights, which are judged together; another as it is."""
    if net.rows != 2 or any(k[2:4] != (1, 0) for k in net.links):
        return net
    weights = np.zeros(net.inputs)
    for _, column, _, _, weight in net.links:
        weights[column] += weight
    return weights.tolist()


def random_net(inputs: int, layers: int, nodes: int, rng: np.random.Generator) -> Net:
    """A net with ``layers`` rows of links, hidden ones of ``nodes`` neurons; a part of the inputs, drawn anew, has no weight."""
    sizes = [inputs, *[min(nodes, inputs)] * (layers - 1), 1]
    silent = rng.random(inputs) < rng.random() * 0.8
    links = []
    for row, (n, m) in enumerate(zip(sizes, sizes[1:])):
        for i in range(n):
            for j in range(m):
                weight = int(rng.integers(0, LARGEST + 1)) * (int(rng.choice((-1, 1))) if row == 0 else 1)
                links.append((row, i, row + 1, j, 0 if row == 0 and silent[i] else weight))
    return Net(inputs, len(sizes), inputs, tuple(links))


def varied(net: Net, percent: float, rng: np.random.Generator) -> Net:
    """A copy of a net with some weights moved by up to a share of themselves, a few of its first row taken out, turned on or turned over."""
    touched, links = rng.random() ** 2, []
    for row, column, to_row, to_column, weight in net.links:
        if rng.random() < touched:
            chance = rng.random()
            if row == 0 and weight == 0 and chance < 0.3:
                weight = int(rng.integers(1, LARGEST // 4)) * int(rng.choice((-1, 1)))
            elif row == 0 and chance < 0.08:
                weight = 0 if chance < 0.05 else -weight
            else:
                weight = int(round(weight * (1 + percent * rng.uniform(-1, 1)) + rng.integers(-3, 4)))
        links.append((row, column, to_row, to_column, weight))
    return Net(net.inputs, net.rows, net.columns, tuple(links))


@dataclass
class Tuned:
    """The best committee (one net, if no several are better), its share of pairs ranked right, and the best share after each phase."""

    nets: list[Net]
    share: float
    shares: dict[str, float] = field(default_factory=dict)


def evolved(
    pairs: DataFrame, inputs: int, start: Sequence[Net] = (), groups: int = 3, members: int = 6, layers: int = 1, nodes: int = 4, percent: float = 0.5, phases: dict[str, int] | None = None, seed: int = 1
) -> Tuned:
    """Nets for pairs (left, right) whose left one is the better: groups x members copies for each round, through PHASES.

    Each member keeps its best net. In the solo phase it varies that, in the group phase its group's best, in the next the best of all; a
    copy that is better takes its member's place. Combos are committees of an odd number of groups' best nets, or the best committee with one of
    its nets varied. A table without pairs returns the first net with share 0. Only scores reach the driver.
    """
    rng = np.random.default_rng(seed)
    table = sign_table(pairs)
    size = groups * members
    best = [start[i] if i < len(start) else random_net(inputs, layers, nodes, rng) for i in range(size)]
    held = np.full(size, -1, np.int64)
    combo, combo_right, total, shares = None, -1, 0, {}

    def scores(committees: list[list[Net]]) -> np.ndarray:
        nonlocal total
        out = np.zeros(len(committees), np.int64)
        for r in population_scores(table, committees).collect():
            out[r["copy"]], total = r["right"], r["total"]
        return out

    for phase, rounds in (phases or PHASES).items():
        for k in range(rounds):
            if phase == "combo":
                leaders = [max(range(g * members, (g + 1) * members), key=lambda i: held[i]) for g in range(groups)]
                copies = []
                for _ in range(size):
                    if combo is not None and rng.random() < 0.7:
                        copy = list(combo)
                        at = int(rng.integers(len(copy)))
                        copy[at] = varied(copy[at], percent, rng)
                    else:
                        odd = int(rng.choice(range(1, groups + 1, 2)))
                        copy = [best[i] for i in rng.choice(leaders, odd, replace=False)]
                    copies.append(copy)
                got = scores(copies)
                top = int(got.argmax())
                if got[top] > combo_right:
                    combo, combo_right = copies[top], int(got[top])
                continue
            copies = []
            for i in range(size):
                mine = range(i // members * members, (i // members + 1) * members)
                own = {"restart": i, "solo": i, "group": max(mine, key=lambda j: held[j]), "all": int(held.argmax())}[phase]
                fresh = phase == "restart" and (k > 0 or i >= len(start))
                copies.append(random_net(inputs, layers, nodes, rng) if fresh else best[i] if phase == "restart" else varied(best[own], percent, rng))
            got = scores([[c] for c in copies])
            for i in np.flatnonzero(got > held):
                best[i], held[i] = copies[i], got[i]
        shares[phase] = max(int(held.max(initial=0)), combo_right, 0) / max(total, 1)
    top = int(held.argmax())
    nets, right = ([best[top]], int(held[top])) if held[top] >= combo_right else (combo, combo_right)
    return Tuned(nets, max(right, 0) / max(total, 1), shares)
