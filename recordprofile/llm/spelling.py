"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary is an acceptor; composed with a transducer that makes exactly one edit
(one code point inserted, deleted or replaced) and with the acceptor again, it accepts
just the pairs of near words.  A state of the composition is (state on the left, edits
made, state on the right): before the edit both sides are at one state, and after it
both must spell the same rest, which two states of a minimised acceptor either can or
can't, whatever led to them; so that is settled once for each pair of states.

The composition is enumerated in partitions by its initial state.  Two near words of c
code points at most share their first c // 2 ones or the others that follow the edit,
so each word stands where its first half leads and, read from the end, where its last
half does, in the classes c of its own length and one more; the acceptor of a partition
holds what its words spell besides.  A partition of more than ``most`` words is divided
again in the same manner, by halves of what is left, until no more than one code point
is; so no task meets many words, however alike they are, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, groups_in_order, join_groups, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many loses a code point, by a checksum of document and run.
LOSING = 199
#: Words of a partition that are composed in one piece.
MOST_WORDS = 4096


class Acceptor:
    """The smallest acyclic automaton of sorted different words: ``final`` and ``arcs`` of each state, the last of which is the first one."""

    def __init__(self, words: Sequence[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        open_: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                final, arcs = open_.pop()
                open_[-1][1][last[len(open_) - 1]] = self._state(final, arcs, known)

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared)
            open_.extend((False, {}) for _ in range(len(word) - shared))
            open_[-1] = (True, open_[-1][1])
            last = word
        close(0)
        self.start = self._state(*open_[0], known)
        self._meet: dict[tuple[int, int], bool] = {}

    def _state(self, final: bool, arcs: dict[str, int], known: dict[tuple, int]) -> int:
        key = (final, tuple(arcs.items()))
        if key not in known:
            known[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(arcs)
        return known[key]

    def _after(self, a: int, b: int) -> list[tuple[str, tuple[int, int]]]:
        """Both sides a symbol further, wherever they share one."""
        mine, other = self.arcs[a], self.arcs[b]
        return [(c, (mine[c], other[c])) for c in mine if c in other]

    def meet(self, a: int, b: int) -> bool:
        """Whether some rest is accepted from both states."""
        known, stack = self._meet, [(a, b)]
        while stack:
            pair = stack[-1]
            if pair not in known:
                if pair[0] == pair[1] or (self.final[pair[0]] and self.final[pair[1]]):
                    known[pair] = True
                else:
                    after = [t for _, t in self._after(*pair)]
                    open_ = [t for t in after if t not in known]
                    if any(known.get(t) for t in after) or not open_:
                        known[pair] = any(known.get(t) for t in after)
                    else:
                        stack.append(open_[0])
                        continue
            stack.pop()
        return known[a, b]

    def rests(self, a: int, b: int) -> Iterator[str]:
        """All that is accepted from both states."""
        stack: list[tuple[int, int, tuple | None]] = [(a, b, None)]
        while stack:
            a, b, read = stack.pop()
            if self.final[a] and self.final[b]:
                yield _spelled(read)
            stack.extend((*t, (read, c)) for c, t in self._after(a, b) if self.meet(*t))

    def one_edit(self) -> Iterator[tuple[str, str]]:
        """The pairs that the composition accepts, each in one direction: of unequal lengths the longer word comes first."""
        stack: list[tuple[int, tuple | None]] = [(self.start, None)]
        while stack:
            state, read = stack.pop()
            arcs = list(self.arcs[state].items())
            for k, (c, to) in enumerate(arcs):
                stack.append((to, (read, c)))
                for d, other in arcs[:k]:
                    if self.meet(to, other):
                        before = _spelled(read)
                        for rest in self.rests(to, other):
                            yield f"{before}{c}{rest}", f"{before}{d}{rest}"
                # Any code point of a run may be the one to go: it is the first.
                if (read is None or read[1] != c) and self.meet(to, state):
                    before = _spelled(read)
                    for rest in self.rests(to, state):
                        yield f"{before}{c}{rest}", f"{before}{rest}"


def _spelled(read: tuple | None) -> str:
    found = []
    while read is not None:
        read, c = read
        found.append(c)
    return "".join(reversed(found))


def spelled_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, losing: int = LOSING) -> DataFrame:
    """One row, ``word``, for each run of letters in the texts that has ``least_length`` code points or more, lower-cased from A to Z.

    A run with a checksum (of document id and run) that ``losing`` divides loses the
    code point that the checksum names; a null id counts as the text null.
    """
    text = F.translate(text_col, UPPER, LOWER)
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{max(1, least_length)},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("null")), F.lit(":"), "run").cast("binary"))
    lost = runs.withColumn("h", h).withColumn("at", F.when(F.col("h") % losing == 0, F.col("h") % F.char_length("run")).cast("int"))
    word = F.when(F.col("at").isNull(), F.col("run")).otherwise(F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)")))
    return lost.select(word.alias("word")).where(F.char_length("word") >= least_length)


def vocabulary(words: DataFrame, *, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur so often."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame, key: Column) -> DataFrame:
    """Rows of (key, left, rest) in the partitions where the first and the last half of ``rest`` lead; ``left`` is the most that it spells."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.expr(shared).alias("shared"), F.expr(rest).alias("rest"), F.expr(left).alias("left")) for s, shared, rest, left in (
        ("<", "substring(rest, 1, left div 2)", "substring(rest, cast(left div 2 as int) + 1)", "cast(left - left div 2 as int)"),
        (">", "right(rest, cast(left - left div 2 as int))", "substring(rest, 1, char_length(rest) - cast(left - left div 2 as int))", "cast(left div 2 as int)"),
    )]))
    kept = rows.select("word", "n", key.alias("key"), sides.alias("s"))
    return kept.select("word", "n", F.concat("key", "s.side", "s.shared").alias("key"), "s.left", "s.rest")


def near_words(words: DataFrame, *, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, near, near_n) for any two words of (word, n), a durable table of different words, with exactly one edit between them, in both directions.

    Null and empty words have no row; other columns are left out.
    """
    rows = words.where("word <> ''").select("word", "n", F.col("word").alias("rest"), F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("left"))
    rows, ready = _halves(rows, F.col("left").cast("string")), []
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("left").alias("longest")).where((F.col("size") > most) & (F.col("longest") > 1))
        sizes, at = settle(sizes.select("key", "size"))
        if sizes.isEmpty():
            discard(words.sparkSession, at)
            break
        met = durable(join_groups(rows, sizes, ["key"], "size", ["word"]))
        ready.append(met.where("size is null").drop("size"))
        rows = _halves(met.where("size is not null"), F.col("key"))
    for part in ready:
        rows = rows.unionByName(part)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int, str, int]] = []
        for group in groups_in_order(batches, ["key"]):
            if group.num_rows < 2:
                continue
            word, n, rest = (group.column(c).to_pylist() for c in ("word", "n", "rest"))
            left, place = group.column("left")[0].as_py(), {r: k for k, r in enumerate(rest)}
            for x, y in Acceptor(sorted(rest)).one_edit():
                # Two words that are both one short of the class meet in their own.
                if len(x) == left:
                    i, j = place[x], place[y]
                    found += [(word[i], n[i], word[j], n[j]), (word[j], n[j], word[i], n[i])]
            if len(found) > 50_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    pairs = rows.repartition("key").sortWithinPartitions("key").mapInArrow(compose, "word string, n long, near string, near_n long")
    # A pair whose edit may stand in either half was met twice.
    return pairs.distinct()


def _pairs(found: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("word", "n", "near", "near_n"), map(list, zip(*found, strict=True)), strict=True)))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms that start at a word end.  Each round follows twice as many steps as the one before it."""
    spark = forms.sparkSession
    now, at = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        fresh, fresh_at = settle(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(spark, at)
        if fresh.where("moved").isEmpty():
            return fresh.select("word", "root")
        now, at = fresh.drop("moved"), fresh_at


def spelling_forms(words: DataFrame, *, times: int = TIMES, most: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n), a durable table of different words.

    A word's form is its near word of the largest n (ties: the smallest in code-point
    order) if that is ``times`` its own n or more, else null; its root is the end of the
    chain of forms, itself if it has none.  As n grows along a chain, chains end.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    met = near_words(words, most=most).groupBy("word").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= times * F.col("n")
    near = durable(met.select("word", "n_near", F.when(is_form, F.col("best.w")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")))
    roots = _roots(near.where("form is not null"))
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``spelling_forms`` of the texts' vocabulary.

    Null and empty texts have no words; rows that repeat an id or a text count each time;
    an empty table has no words; other columns are left out.  Texts and words may have any
    length.  Words are compared in code points, without further case or accent folding.
    """
    words = durable(vocabulary(spelled_words(docs, id_col=id_col, text_col=text_col)))
    return spelling_forms(words, **options)
