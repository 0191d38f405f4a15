"""Words of texts that are written without blanks: a dictionary learned from the corpus, and best paths through a lattice.

``letters`` is a class of letters (between brackets in a pattern) that need segmenting; runs of other letters and
digits are one unit each, which no word cuts. A dictionary is a table ``(word, n)``: a word and how often it is used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

HAN = r"\p{IsHan}"

#: Places of texts at which strings begin that a task counts before it hands the counts on.
COUNTED = 2_000_000
#: Places of a text that go down a trie together; rows of counts in a batch.
STRETCH = 10_000
#: Words in one trie.
WORDS = 1_000_000


# -- learning words --------------------------------------------------------------------------


def _prefixes(letters: np.ndarray, begins: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(strings, counts)`` of one letter, of two, up to ``longest``, that begin at the places ``begins`` of a row of code points; 0 is the end of a run.

    As many letters as go into 63 bits make one number, and numbers are sorted: one sorting counts the strings of all these
    lengths. What is longer goes on from the rank of its beginning."""
    used = np.flatnonzero(np.bincount(letters, minlength=1))
    used = used[used > 0]
    if not len(used):
        return
    bits, table = int(len(used)).bit_length(), np.zeros(used[-1] + 1, np.int32)
    table[used] = np.arange(1, len(used) + 1)
    small, mask = np.concatenate([table[letters], np.zeros(longest, np.int32)]), (1 << bits) - 1
    del letters
    ranks, before, done = np.zeros(len(begins), np.int64), np.empty((1, 0), np.uint32), 0
    while done < longest and len(begins):
        width = min(longest - done, (63 - len(before).bit_length()) // bits)
        keys, live = ranks, np.ones(len(begins), bool)
        for k in range(width):
            letter = small[begins + done + k]
            live &= letter > 0
            keys = keys << bits | np.where(live, letter, 0)
        whole = keys[live] if done + width < longest else None
        keys.sort()
        for k in range(1, width + 1):
            some = keys >> bits * (width - k)
            some = some[some & mask > 0]
            if not len(some):
                return
            first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            found, n = some[first], np.diff(np.append(first, len(some)))
            strings = np.empty((len(found), done + k), np.uint32)
            strings[:, :done] = before[found >> bits * k]
            for j in range(k):
                strings[:, done + j] = used[(found >> bits * (k - 1 - j) & mask) - 1]
            yield strings.view(f"U{done + k}").ravel(), n
        done += width
        if done < longest:
            before, begins, ranks = strings, begins[live], np.unique(whole, return_inverse=True)[1]


def gram_counts(rows: DataFrame, text_col: str = "text", letters: str = HAN, longest: int = 5) -> DataFrame:
    """``(gram, n)``: how often each string of one to ``longest`` letters is in the runs of ``letters`` of the texts.

    A task counts ``COUNTED`` places at a time before anything is shuffled, so a string that is everywhere costs a row for each such lot. A null
    text has no runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begins, size = [], [], 0

        def lot() -> Iterator[pa.RecordBatch]:
            some = _prefixes(np.concatenate(held), np.concatenate(begins), longest) if held else ()
            held.clear()
            begins.clear()
            for grams, n in some:
                for k in range(0, len(n), STRETCH):
                    yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + STRETCH], pa.string()), pa.array(n[k : k + STRETCH], pa.int64())], names=["gram", "n"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                for k in range(0, len(text), COUNTED):
                    # letters beyond the stretch are looked at, but no string begins there
                    part = _letters(text[k : k + COUNTED + longest - 1] + "\n").astype(np.int32)
                    part[part == 10] = 0
                    begins.append((size + np.flatnonzero(part[:COUNTED])).astype(np.int32))
                    held.append(part)
                    size += len(part)
                    if size >= COUNTED:
                        yield from lot()
                        size = 0
        yield from lot()

    runs = F.regexp_replace(F.lower(F.col(text_col)), f"[^{letters}]+", "\n")
    return rows.select(runs.alias("runs")).filter("runs <> ''").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _entropy(grams: DataFrame, words: DataFrame, core: Column, label: str) -> DataFrame:
    """``(gram, label)``: entropy of what stands beside a word; the ends of runs count as one more letter.

    With c uses of which n are beside each letter it is ln c - (sum of n ln n) / c, so plain sums do."""
    beside = grams.filter(F.length("gram") > 2).select(core.alias("gram"), F.col("n").cast("double").alias("m"))
    sums = beside.groupBy("gram").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.ln("m")).alias("mm"))
    n = F.col("n").cast("double")
    end = n - F.coalesce("m", F.lit(0.0))
    total = F.coalesce("mm", F.lit(0.0)) + F.when(end > 0, end * F.ln(end)).otherwise(F.lit(0.0))
    return words.select("gram", "n").join(sums, "gram", "left").select("gram", (F.ln(n) - total / n).alias(label))


def learn_words(rows: DataFrame, text_col: str = "text", letters: str = HAN, longest: int = 4, min_count: int = 5) -> DataFrame:
    """``(word, n, cohesion, left, right)`` of every string of two to ``longest`` letters that is used ``min_count`` times.

    ``cohesion`` is how much oftener the word is used than its parts would meet by chance, at the worst place to cut
    it; ``left`` and ``right`` are the entropies of what stands beside it. Only equi-joins on strings; an
    empty table, or texts without runs, give no words."""
    grams = written(gram_counts(rows, text_col, letters, longest + 1), "grams")
    often = grams.filter(F.col("n") >= min_count)
    words = often.filter(F.length("gram").between(2, longest))
    letters_used = grams.filter(F.length("gram") == 1).agg(F.sum("n").cast("double").alias("all"))  # one row
    cuts = words.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    cuts = cuts.select("gram", "n", F.substring("gram", F.lit(1), F.col("k")).alias("a"), F.substring("gram", F.col("k") + 1, F.length("gram")).alias("b"))
    # a part is used at least as often as the whole, so it is never missing
    cuts = cuts.join(often.select(F.col("gram").alias("a"), F.col("n").alias("na")), "a").join(often.select(F.col("gram").alias("b"), F.col("n").alias("nb")), "b")
    ratio = F.col("n") * F.col("all") / (F.col("na").cast("double") * F.col("nb"))
    cohesion = cuts.join(F.broadcast(letters_used)).groupBy("gram").agg(F.min(ratio).alias("cohesion"))
    left = _entropy(grams, words, F.substring("gram", F.lit(2), F.length("gram")), "left")
    right = _entropy(grams, words, F.substring("gram", F.lit(1), F.length("gram") - 1), "right")
    return words.join(cohesion, "gram").join(left, "gram").join(right, "gram").select(F.col("gram").alias("word"), "n", "cohesion", "left", "right")


def likely_words(learned: DataFrame, min_cohesion: float = 20.0, min_entropy: float = 1.0) -> DataFrame:
    """``(word, n)`` of the learned strings that hold together and stand free on both sides."""
    return learned.filter((F.col("cohesion") >= min_cohesion) & (F.least("left", "right") >= min_entropy)).select("word", "n")


def user_words(entries: DataFrame) -> DataFrame:
    """``(word, n)`` of the lines ``entry`` of a user dictionary: word, uses, class. Other lines are left out."""
    word, n = (F.regexp_extract("entry", r"^(.*\S) +(\d+) +\w+$", k) for k in (1, 2))
    found = entries.select(F.lower(word).alias("word"), n.try_cast("bigint").alias("n"))
    return found.filter("word <> '' AND n IS NOT NULL")


def dictionary(*parts: DataFrame) -> DataFrame:
    """``(word, n)`` of several dictionaries; a word that is in more than one has its largest count."""
    every = parts[0].select("word", "n")
    for p in parts[1:]:
        every = every.unionByName(p.select("word", "n"))
    return every.filter("word <> '' AND n > 0").groupBy("word").agg(F.max("n").alias("n"))


# -- segmentation ----------------------------------------------------------------------------


def _trie(words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A prefix trie in two arrays, 16 bytes a node: node k + 1 is entered from node ``keys[k] >> 21`` (0 is the root) by
    the letter in the lower bits, and weighs ``values[k]`` (NaN: no word ends there). Nodes are numbered by depth, so keys rise."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters, begin = _letters("".join(words)), np.cumsum(size) - size
    node, keys, values, depth = np.zeros(len(words), np.int64), [np.empty(0, np.int64)], [np.empty(0)], 0
    count, left = 0, np.arange(len(words))
    while len(left := left[size[left] > depth]):
        found, at = np.unique(node[left] << 21 | letters[begin[left] + depth], return_inverse=True)
        node[left] = at + count + 1
        depth += 1
        value, whole = np.full(len(found), np.nan), size[left] == depth
        value[at[whole]] = weights[left[whole]]
        keys.append(found)
        values.append(value)
        count += len(found)
    return np.concatenate(keys), np.concatenate(values)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _met(text: str, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(ends, sizes, weights)`` of the words of a trie that are in a text; all places of a stretch go down the trie together."""
    letters = _letters(text)
    for begin in range(0, len(letters) if len(keys) else 0, STRETCH):
        at = np.arange(begin, min(begin + STRETCH, len(letters)))
        node, depth = np.zeros(len(at), np.int64), 0
        while len(at):
            key = node << 21 | letters[at + depth]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            at, place = at[hit], place[hit]
            depth += 1
            ends = ~np.isnan(values[place])
            yield at[ends] + depth, np.full(np.count_nonzero(ends), depth), values[place[ends]]
            more = at + depth < len(letters)
            at, node = at[more], place[more] + 1


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """``(begin, piece)`` of a text: as many whole blocks as go into ``STRETCH`` letters, or a longer block by itself."""
    begin = 0
    while begin < len(text):
        end = len(text)
        if end - begin > STRETCH:
            end = text.rfind("\n", begin, begin + STRETCH) + 1 or text.find("\n", begin) + 1 or end
        yield begin, text[begin:end]
        begin = end


def best_path(text: str, ends, sizes, weights, floor: float, inside: Callable[[str], Iterator]) -> list[str]:
    """The units and words of ``text`` on the path with the largest sum of log weights; blocks end at line feeds.

    ``ends, sizes, weights`` are the lattice's words; a unit that no word covers weighs ``floor``. Of equal paths the
    one whose last word is longer wins, at every place. ``inside`` finds the runs that are one unit."""
    n = len(text)
    cut = np.ones(n + 1, bool)
    unit = np.arange(-1, n)  # where the unit that ends here begins
    for m in inside(text):
        a, b = m.span()
        cut[a + 1 : b] = False
        unit[b] = a
    ends, sizes, weights = np.asarray(ends, np.int64), np.asarray(sizes, np.int64), np.asarray(weights, np.float64)
    fits = cut[ends] & cut[ends - sizes]
    ends, sizes, weights = ends[fits], sizes[fits], weights[fits]
    order = np.lexsort((-sizes, ends))
    ends, sizes, weights = ends[order].tolist(), sizes[order].tolist(), weights[order].tolist()
    ends.append(n + 1)
    best, back = [0.0] * (n + 1), unit.tolist()
    place = 0
    for e in np.flatnonzero(cut[1:]).tolist():
        e += 1
        if text[e - 1] == "\n":  # sums start anew, so that far blocks cannot blur a choice
            continue
        top, begin = -math.inf, e
        while ends[place] == e:
            s = e - sizes[place]
            if (total := best[s] + weights[place]) > top:
                top, begin = total, s
            place += 1
        u = back[e]
        if (total := best[u] + floor) > top:
            top, begin = total, u
        best[e], back[e] = top, begin
    found, e = [], n
    while e > 0:
        found.append(text[back[e] : e])
        e = back[e]
    return [x for x in reversed(found) if x != "\n"]


def segment(rows: DataFrame, words: DataFrame, id_col: str = "id", text_col: str = "text", letters: str = HAN, shortest: int = 2, shard: int = WORDS) -> DataFrame:
    """``(id, terms)``: the terms of each text in small letters and in order, those of ``shortest`` letters or more.

    A trie finds the words of the dictionary ``words(word, n)`` at every place of a text in one reading; these make
    the text's lattice, and its most likely path (each word as likely as it is used) gives the terms. A letter
    that is in no word is a unit of one use. Words of several blocks (with blanks or signs inside) are never met, so they
    count among the uses but are in no trie. A trie has at most ``shard`` words; a larger dictionary is dealt into shards,
    and the rows are written with their lattice after each, so that a worker holds one trie whatever the dictionary. Blocks do
    not bear upon each other, so a text goes piece by piece, and a worker holds the paths of one piece beside the row. A row
    is kept whatever its text: null and empty texts have no terms."""
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = words.filter(~F.col("word").rlike(rf"[^{letters}\p{{L}}\p{{N}}]"))
    floor = -math.log(max(1, total))
    shards = max(1, -(-words.count() // (shard * 3 // 4)))  # a quarter is left, as a hash deals unevenly
    blocks = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(rf"[{letters}\p{{L}}\p{{N}}]+"), F.lit(0))
    flow = rows.select(F.col(id_col).alias("id"), F.array_join(blocks, "\n").alias("s"))
    flow = flow.select("id", "s", F.array().cast("array<int>").alias("ends"), F.array().cast("array<int>").alias("sizes"), F.array().cast("array<double>").alias("weights"))

    def step(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import regex

            inside = regex.compile(rf"[^{letters}\n]+").finditer
            names, kinds = (["id", "terms"], [pa.string()]) if last else (["id", "s", "ends", "sizes", "weights"], [pa.int32(), pa.int32(), pa.float64()])
            for batch in batches:
                # a row at a time and a piece at a time, so that the lattice and the paths of one piece are held
                for k in range(batch.num_rows):
                    held, found = tuple(c[k].values.to_numpy() for c in batch.columns[2:]), [[pa.array([], t)] for t in kinds]
                    for begin, piece in _pieces(batch.column(1)[k].as_py()):
                        some = slice(*np.searchsorted(held[0], (begin, begin + len(piece)), "right"))
                        ends, sizes, weights = (np.concatenate(c) for c in zip((held[0][some] - begin, held[1][some], held[2][some]), *_met(piece, *shared.value)))
                        if last:
                            parts = ([t for t in best_path(piece, ends, sizes, weights, floor, inside) if len(t) >= shortest],)
                        else:  # in the order of their ends, so that the next step finds those of a piece
                            order = np.argsort(ends, kind="stable")
                            parts = ends[order] + begin, sizes[order], weights[order]
                        for have, more, t in zip(found, parts, kinds):
                            have.append(pa.array(more, t))
                    arrays = [pa.ListArray.from_arrays([0, sum(map(len, have))], pa.concat_arrays(have)) for have in found]
                    yield pa.RecordBatch.from_arrays([batch.column(c).slice(k, 1) for c in range(1 if last else 2)] + arrays, names=names)

        return run

    for k in range(shards):
        some = words.filter(F.pmod(F.xxhash64("word"), F.lit(shards)) == k).select("word", F.ln(F.col("n") / F.lit(float(max(1, total)))).alias("w")).toArrow()
        shared = spark.sparkContext.broadcast(_trie(some.column(0).to_pylist(), some.column(1).to_numpy()))
        last = k == shards - 1
        flow = flow.mapInArrow(step(shared, last), f"id {kind}, terms array<string>" if last else f"id {kind}, s string, ends array<int>, sizes array<int>, weights array<double>")
        if not last:
            flow = written(flow, "lattice")
            shared.unpersist()
    return flow


def cutter(words: DataFrame, letters: str = HAN, shard: int = WORDS) -> Callable[[DataFrame], DataFrame]:
    """A function from rows ``(id, text)`` to ``(id, terms)`` by this dictionary, as an index takes it."""
    return lambda rows: segment(rows, words, letters=letters, shard=shard)
