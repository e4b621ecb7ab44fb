"""Spelling variants: k-d trees over the letter counts of words.

One edit changes the letter counts of a word by at most two in sum: an insert
adds one letter, a replacement takes one and adds another.  So the words near a
word lie in a small box around its counts.  For each pair of lengths (L, L) and
(L, L + 1), the counts of the shorter words search a k-d tree of the others:
a branch is pruned when its box needs more than the one letter added, and for
equal lengths the one taken, that an edit allows.  What is left is compared
letter by letter, since counts don't know their order.

The trees have two levels.  The upper one, from a sample, deals the words of a
length to cells of about ``CELL`` words; a search visits every cell its box
touches.  Inside a cell a tree of all its words is built.  Words with equal
counts are never one edit apart, so they are searched together, as one point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.common import ragged, written

#: Letters a to z and U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Words of a cell, points of a leaf, words that stand for one cell when the upper trees are fitted, and most cells of a length.
CELL, LEAF, PER_CELL, MOST_CELLS = 25_000, 32, 40, 4096
#: Candidate pairs that are compared letter by letter at a time.
PAIRS = 200_000
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("near", pa.string())])


def spelled(words: list[str]) -> np.ndarray:
    """(N, L) letter numbers of words of one length."""
    codes = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).reshape(len(words), -1)
    return np.where(codes < 128, codes - ord("a"), codes - 0xC0 + 26).astype(np.uint8)


def counted(codes: np.ndarray) -> np.ndarray:
    """(N, LETTERS) how often each letter occurs; sums of squares of the counts are exact."""
    n, size = codes.shape
    out = np.zeros((n, LETTERS), np.float32 if size <= 2000 else np.float64)
    rows = max(1, 4_000_000 // max(1, size))
    for at in range(0, n, rows):
        some = codes[at: at + rows]
        flat = np.arange(len(some))[:, None] * LETTERS + some
        out[at: at + rows] = np.bincount(flat.ravel(), minlength=len(some) * LETTERS).reshape(len(some), LETTERS)
    return out


@dataclass
class Tree:
    """Inner node k sends counts of letter ``letter[k]`` up to ``value[k]`` to ``child[k, 0]``, greater ones to ``child[k, 1]``.

    A child below zero is leaf ``-1 - child``.  A tree of one leaf has no inner node.
    """

    letter: np.ndarray
    value: np.ndarray
    child: np.ndarray
    leaves: int

    def visits(self, counts: np.ndarray, add: int, take: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf whose box is in reach of a row by ``add`` letters more and ``take`` letters less."""
        rows, leaves = [], []
        every = np.arange(len(counts))
        stack = [(0 if len(self.letter) else -1, every, np.full(len(counts), add), np.full(len(counts), take))]
        while stack:
            node, who, more, less = stack.pop()
            if not len(who):
                continue
            if node < 0:
                rows.append(who)
                leaves.append(np.full(len(who), -1 - node))
                continue
            here, split = counts[who, self.letter[node]], self.value[node]
            down = (here > split).astype(np.int64)
            low = (down == 0) | ((here == split + 1) & (less > 0))
            high = (down == 1) | ((here == split) & (more > 0))
            stack.append((int(self.child[node, 0]), who[low], more[low], less[low] - down[low]))
            stack.append((int(self.child[node, 1]), who[high], more[high] - 1 + down[high], less[high]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (every[:0], every[:0])


def grown(points: np.ndarray, leaf: int) -> Tree:
    """A tree of ``points`` with leaves of at most ``leaf`` of them, unless they are all equal."""
    letter, value, child = [], [], []
    leaves = 0
    stack = [(np.arange(len(points)), -1, 0)]
    while stack:
        who, parent, side = stack.pop()
        here = points[who]
        spread = here.var(0) if len(who) > leaf else np.zeros(1)
        if spread.max() > 0:
            axis = int(spread.argmax())
            split = min(float(np.floor(np.median(here[:, axis]))), float(here[:, axis].max()) - 1)
            number = len(letter)
            letter.append(axis)
            value.append(split)
            child.append([0, 0])
            low = here[:, axis] <= split
            stack += [(who[low], number, 0), (who[~low], number, 1)]
        else:
            leaves += 1
            number = -leaves
        if parent >= 0:
            child[parent][side] = number
    return Tree(np.array(letter, np.int64), np.array(value), np.array(child, np.int64).reshape(-1, 2), leaves)


def one_edit(short: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each row of ``other`` comes from that of ``short`` by one replaced or one inserted letter."""
    n, size = short.shape
    same = short == other[:, :size]
    if other.shape[1] == size:
        return same.sum(1) == size - 1
    # Equal letters from the front and, shifted by the new letter, from the back cover the shorter word.
    front = np.where(same.all(1), size, same.argmin(1))
    shifted = (short == other[:, 1:])[:, ::-1]
    back = np.where(shifted.all(1), size, shifted.argmin(1))
    return front + back >= size


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with equal counts are one class: a row of each, all rows by class, and where each class begins and how many it has."""
    keys = np.ascontiguousarray(counts.astype(np.uint32)).view(np.dtype((np.void, 4 * LETTERS))).ravel()
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    size = np.bincount(which, minlength=len(first))
    return first, np.argsort(which, kind="stable"), np.cumsum(size) - size, size


def near(short: list[str], other: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (number in ``short``, number in ``other``) one edit apart, in parts.

    The words of each list have one length, those of ``other`` the same or one more.
    """
    a, b = spelled(short), spelled(other)
    take = int(a.shape[1] == b.shape[1])
    a_counts, b_counts = counted(a), counted(b)
    a_first, a_rows, a_begin, a_size = classes(a_counts)
    b_first, b_rows, b_begin, b_size = classes(b_counts)
    points, asked = b_counts[b_first], a_counts[a_first]
    tree = grown(points, LEAF)
    home = np.empty(len(points), np.int64)
    row, leaf = tree.visits(points, 0, 0)
    home[row] = leaf
    by_leaf = np.argsort(home, kind="stable")
    leaf_begin = np.searchsorted(home[by_leaf], np.arange(tree.leaves + 1))
    who, where = tree.visits(asked, 1, take)
    order = np.argsort(where, kind="stable")
    who, bounds = who[order], np.searchsorted(where[order], np.arange(tree.leaves + 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for k in range(tree.leaves):
        inside, visitors = by_leaf[leaf_begin[k]: leaf_begin[k + 1]], who[bounds[k]: bounds[k + 1]]
        for at in range(0, len(visitors), 20_000):
            some = visitors[at: at + 20_000]
            p, q = points[inside], asked[some]
            # A replacement has squared distance two, an insert one.
            square = (q * q).sum(1)[:, None] - 2 * (q @ p.T) + (p * p).sum(1)
            i, j = np.nonzero(square == 1 + take)
            found.append((some[i], inside[j]))
            waiting += int((a_size[some[i]] * b_size[inside[j]]).sum())
            if waiting > PAIRS:
                yield from _compared(a, b, found, (a_rows, a_begin, a_size), (b_rows, b_begin, b_size))
                found, waiting = [], 0
    yield from _compared(a, b, found, (a_rows, a_begin, a_size), (b_rows, b_begin, b_size))


def _compared(a, b, found, a_class, b_class) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word pairs of pairs of classes that are one edit apart."""
    if not found:
        return
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    (a_rows, a_begin, a_size), (b_rows, b_begin, b_size) = a_class, b_class
    # Each word of the left class once, then all words of the right class for it.
    n = a_size[left]
    word, with_class = a_rows[np.repeat(a_begin[left], n) + ragged(n)], np.repeat(right, n)
    m = b_size[with_class]
    ends = np.cumsum(m)
    at = 0
    while at < len(word):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        size = m[at: to]
        i = np.repeat(word[at: to], size)
        j = b_rows[np.repeat(b_begin[with_class[at: to]], size) + ragged(size)]
        for k in range(0, len(i), 4 * PAIRS):
            ii, jj = i[k: k + 4 * PAIRS], j[k: k + 4 * PAIRS]
            good = one_edit(a[ii], b[jj])
            yield ii[good], jj[good]
        at = to


@dataclass
class Cells:
    """The upper trees by length, and into how many parts each overfull cell is cut."""

    trees: dict[int, Tree]
    parts: dict[str, int]

    def _names(self, words: list[str], size: int, add: int, take: int) -> tuple[np.ndarray, list[str]]:
        """(number of a word, cell) of all cells of length ``size`` within reach."""
        tree = self.trees.get(size)
        if tree is None:
            return np.arange(len(words)), [f"{size}"] * len(words)
        who, leaf = tree.visits(counted(spelled(words)), add, take)
        return who, [f"{size}.{k}" for k in leaf.tolist()]

    def homes(self, words: list[str], size: int) -> tuple[np.ndarray, list[str]]:
        return self._names(words, size, 0, 0)

    def dealt(self, words: list[str], hashes: list[int]) -> tuple[list[str], list[int], list[int]]:
        """Cell, role and number of each word of one length: home as a point (0), and to the cells that it searches for equal (1) and greater length (2)."""
        size = len(words[0])
        cells_, roles, numbers = [], [], []
        for role, (who, cells) in enumerate((self.homes(words, size), self._names(words, size, 1, 1), self._names(words, size + 1, 1, 0))):
            for k, cell in zip(who.tolist(), cells, strict=True):
                parts = self.parts.get(cell, 1)
                own = hashes[k] % parts
                cells_ += [f"{cell}/{own}/{p}" if role == 0 else f"{cell}/{p}/{own}" for p in range(parts)]
                roles += [role] * parts
                numbers += [k] * parts
        return cells_, roles, numbers


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Numbers of the words of each length."""
    found: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        found.setdefault(len(word), []).append(k)
    yield from found.values()


def upper_trees(words: DataFrame, cell: int = CELL) -> Cells:
    """Trees for the lengths with more than ``cell`` words, from a sample whose size is a share of the number of words."""
    size = F.length("word")
    large = {r["size"]: r["n"] for r in words.groupBy(size.alias("size")).agg(F.count("*").alias("n")).filter(F.col("n") > cell).collect()}
    if not large:
        return Cells({}, {})
    leaves = {k: min(MOST_CELLS, 2 ** int(np.ceil(np.log2(n / cell)))) for k, n in large.items()}
    wanted = F.create_map(*(F.lit(x) for k, n in leaves.items() for x in (k, n * PER_CELL)))
    rank = F.row_number().over(Window.partitionBy(size).orderBy(F.xxhash64("word", F.lit(17)), "word"))
    picked = words.filter(size.isin(*large)).select("word", rank.alias("nth")).filter(F.col("nth") <= max(leaves.values()) * PER_CELL).filter(F.col("nth") <= wanted[size])
    sample: dict[int, list[str]] = {}
    for r in picked.select("word").collect():
        sample.setdefault(len(r["word"]), []).append(r["word"])
    cells = Cells({k: grown(counted(spelled(sorted(sample[k]))), max(1, len(sample[k]) // leaves[k])) for k in sample}, {})

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            for rows in by_length(some):
                names = cells.homes([some[k] for k in rows], len(some[rows[0]]))[1]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["cell"])

    # Words with equal counts cannot be split by counts; a cell they overfill is cut into blocks that meet pairwise.
    full = words.select("word").mapInArrow(homes, "cell string").groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > 3 * cell).collect()
    cells.parts = {r["cell"]: -(-r["n"] // cell) for r in full}
    return cells


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (struct ``less``: minus the n, ``near``: the word) of every word that has a near one.

    ``words`` has distinct ``word``s of letters a-z and U+00C0 to U+00FF, and their ``n``.
    """
    cells = upper_trees(words, cell)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, hashes = batch.column("word").to_pylist(), batch.column("h").to_pylist()
            for rows in by_length(some):
                names, roles, numbers = cells.dealt([some[k] for k in rows], [hashes[k] for k in rows])
                at = pa.array(np.array(rows)[np.array(numbers, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(roles, pa.int32()), batch.column("word").take(at), batch.column("n").take(at)], ["cell", "role", "word", "n"])

    def search(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()

        def of(which: int) -> tuple[list[str], np.ndarray]:
            some = group.filter(pa.array(role == which)).sort_by("word")
            return some.column("word").to_pylist(), some.column("n").to_numpy()

        other, other_n = of(0)
        out = []
        for which in (1, 2):
            short, short_n = of(which)
            if not short or not other:
                continue
            mine, theirs = _Best(short, other, other_n), _Best(other, short, short_n)
            for i, j in near(short, other):
                mine.add(i, j)
                if which == 2:
                    theirs.add(j, i)
            out += [mine.table()] + ([theirs.table()] if which == 2 else [])
        return pa.concat_tables(out) if out else FOUND.empty_table()

    dealt = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(1 << 30)).alias("h")).mapInArrow(deal, "cell string, role int, word string, n long")
    found = dealt.groupBy("cell").applyInArrow(search, "word string, n_near long, less long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


class _Best:
    """Counts the near words of each word and keeps the one of largest n, of equal ones the first; both lists are sorted."""

    def __init__(self, words: list[str], partners: list[str], n: np.ndarray):
        self.words, self.partners, self.n = words, partners, n
        self.count = np.zeros(len(words), np.int64)
        # Partners by falling n, then by word: the best partner has the least place.
        order = np.lexsort((np.arange(len(partners)), -n))
        self.order, self.place = order, np.empty(len(partners), np.int64)
        self.place[order] = np.arange(len(partners))
        self.best = np.full(len(words), len(partners), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.count += np.bincount(i, minlength=len(self.words))
        np.minimum.at(self.best, i, self.place[j])

    def table(self) -> pa.Table:
        has = np.flatnonzero(self.count)
        which = self.order[self.best[has]] if len(has) else has
        return pa.table([[self.words[k] for k in has], self.count[has], -self.n[which].astype(np.int64), [self.partners[k] for k in which]], schema=FOUND)


def roots(links: DataFrame, max_rounds: int = 12) -> DataFrame:
    """``word`` and ``root``, where following ``links(word, form)`` ends; every word has at most one form and forms grow in n, so no ring exists.

    Each round doubles the steps that are taken; rounds end when nothing moves.
    """
    now = written(links.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max_rounds):
        after = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        moved = now.join(after, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = written(moved, "forms")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now
    raise RuntimeError(f"forms still move after {max_rounds} rounds")


def variants(words: DataFrame, ratio: int = 10, cell: int = CELL) -> DataFrame:
    """``word, n, form, form_n, root, n_near`` of every row of ``words(word, n)``, whose words are distinct.

    Near words differ by exactly one inserted, deleted or replaced letter.  The
    near word of largest n (ties: the first in code-point order) is the form if
    it is at least ``ratio`` (two or more) times as frequent.  ``root`` follows forms to the last,
    and is the word itself where there is none.  Other columns take no part;
    null words are dropped; an empty table gives an empty one.  Words may only
    have letters a-z and U+00C0 to U+00FF.
    """
    if ratio < 2:
        raise ValueError("ratio: two or more")
    counts = words.select("word", F.col("n").cast("long").alias("n")).filter("word <> ''")
    close = near_words(counts, cell).select(F.col("word").alias("w"), "n_near", "best")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = written(counts.join(close, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")), "variants")
    last = roots(found.filter("form is not null")).select(F.col("word").alias("w"), F.col("root").alias("last"))
    joined = found.join(last, F.col("word") == F.col("w"), "left")
    return joined.select("word", "n", "form", "form_n", F.coalesce("last", "word").alias("root"), "n_near")
