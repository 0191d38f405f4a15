"""BPE encoding as a bounded-lookahead transducer, and incremental decoding.

A boundary between two tokens can depend on text to its right only through a chain of
merges, each one with a later rank than the one to its right and next to it. The longest
such chain in a merge list, in bytes, is its sufficient lookahead: a boundary found that far
from the end of what has been read holds whatever follows. So the encoder keeps a window of
bounded length, emits the tokens that are stable and forgets them.

Decoding goes through the ids one at a time and keeps at most the bytes of one unfinished
character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SUFFIX = "</w>"
#: Bytes taken in at a time beyond the lookahead, and words remembered by a worker.
WINDOW_BYTES, KNOWN_WORDS = 256, 400_000
#: Longer words are not remembered, so that what a worker remembers is bounded.
KNOWN_LETTERS = 64
#: Words whose ids are hashed and decoded at a time.
WORDS_AT_ONCE = 2000
NONE = 1 << 60

#: White space as Unicode has it (fixed by the vocabulary's normalizer).
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that the regex module takes for letters or numbers and Unicode 16 does not (fixed values).
_NEWER = (
    "0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_NEW = "".join("-".join(chr(int(x, 16)) for x in span.split("-")) for span in _NEWER.split())
_LETTER, _NUMBER = rf"[\p{{L}}--[{_NEW}]]", rf"[\p{{N}}--[{_NEW}]]"
#: Case pairs of Unicode 16 that this Python does not know, and sigma, which has no final form here (fixed values).
_CASE = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
_CASED = regex.compile("[" + "".join(map(chr, _CASE)) + "]")
_BLANKS = regex.compile(f"[{_BLANK}]+")
#: The vocabulary's own split pattern (fixed by its file).
_PIECES = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}|[[^{_BLANK}\p{{L}}\p{{N}}]||[{_NEW}]]+")
#: The same for texts of the first code points only, where the built-in engine does with plain sets.
_LOW = range(0x250)
_LOW_LETTERS, _LOW_NUMBERS = ("".join(chr(c) for c in _LOW if unicodedata.category(chr(c))[0] == k) for k in "LN")
_LOW_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW_LETTERS}]+|[{_LOW_NUMBERS}]|[^\t-\r \x85\xa0{_LOW_LETTERS}{_LOW_NUMBERS}]+")
_LOW_BLANKS = re.compile(r"[\t-\r \x85\xa0]+")
_HIGH = re.compile(f"[^{chr(0)}-{chr(_LOW[-1])}]")


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Bytes of right context that settle every boundary.

    A merge (u, v) carries a change at the start of v to the start of u. The next merge of a
    chain must have a later rank and a right part that begins with u, so one pass in the order
    of ranks finds the longest chain. ``length`` has each token's bytes.
    """
    first: dict[str, str] = {}  # a merged token's left part
    best: dict[str, int] = {}
    longest = 0
    for u, v in merges:
        reach, t = 0, v
        while t is not None:
            reach = max(reach, best.get(t, 0))
            t = first.get(t)
        best[u] = max(best.get(u, 0), reach + length[u])
        longest = max(longest, best[u])
        first.setdefault(u + v, u)
    return longest + max(length.values(), default=0)


class _Known(dict):
    """What the transducer has told of words met before; forgotten all at once when they are too many."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> str:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        out = " ".join(map(str, self.bpe.transduce(word.encode())))
        if len(word) <= KNOWN_LETTERS:
            self[word] = out
        return out


class Bpe:
    """A word-level BPE vocabulary with an end-of-word suffix, read from a tokenizer file."""

    def __init__(self, file: str):
        spec = json.loads(file)
        self.vocab: dict[str, int] = dict(spec["model"]["vocab"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        # a pair's rank and what it becomes, in one number each
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: r << 20 | self.vocab[a + b] for r, (a, b) in reversed([*enumerate(merges)])}
        self.length = {t: len(t.removesuffix(SUFFIX)) or len(t) for t in self.vocab}
        self.lookahead = sufficient_lookahead(merges, self.length)
        alphabet = byte_alphabet()
        self.start = [self.vocab[c] for c in alphabet]
        self.final = [self.vocab[c + SUFFIX] for c in alphabet]
        self.byte = {c: b for b, c in enumerate(alphabet)}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = _Known(self)

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of the least rank, the leftmost first, until no pair is left."""
        rank, ids = self.rank, [*ids]
        ranks = [rank.get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NONE:
            k = ranks.index(least)
            new = ids[k] = least & 0xFFFFF
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank.get(ids[k - 1] << 20 | new, NONE)
            if k < len(ranks):
                ranks[k] = rank.get(new << 20 | ids[k + 1], NONE)
        return ids

    def transduce(self, word: Iterable[int]) -> Iterator[int]:
        """Token ids of one word, given as bytes; a token is emitted once nothing can change it.

        Every word is encoded here. The state is the window: the bytes whose tokens are not
        settled yet, the lookahead among them."""
        window: list[int] = []
        source = iter(word)
        ahead, room = next(source, None), self.lookahead + WINDOW_BYTES
        while ahead is not None or window:
            if ahead is not None:
                taken = [ahead, *islice(source, room - len(window) - 1)]
                ahead = next(source, None)
                window += map(self.start.__getitem__, taken[:-1])
                window.append((self.final if ahead is None else self.start)[taken[-1]])
            stable = len(window) if ahead is None else len(window) - self.lookahead
            done = 0
            for i in self._merge(window):
                done += self.length[self.token[i]]
                if done > stable:
                    done -= self.length[self.token[i]]
                    break
                yield i
            window = window[done:]
            if len(window) >= room:  # a token longer than the window allows to settle
                room += WINDOW_BYTES

    def found(self, text: str) -> Iterator[str]:
        """Of each word its ids, joined by one space; strings of special tokens have one id."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield str(self.special[part])
                continue
            if _HIGH.search(part):
                plain = _BLANKS.sub(" ", unicodedata.normalize("NFC", part))
                plain = (plain.translate(_CASE) if _CASED.search(plain) else plain).lower()
            else:
                plain = _LOW_BLANKS.sub(" ", part).lower()
            for m in (_PIECES if _HIGH.search(plain) else _LOW_PIECES).finditer(plain):
                yield self.known[m[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.found(text) for i in ids.split(" ")]

    def decode(self, ids: Iterable[int], readable: bool = False) -> str:
        machine = Decoder(self, readable)
        return machine.push(ids) + machine.end()


class Decoder:
    """Incremental decoding: ids go in one after another, text comes out as soon as it is settled.

    The vocabulary has no decoder of its own, so its decoding shows every token, one space apart;
    the state is whether a token has come. A ``readable`` decoding turns tokens to bytes and these
    to text, a word's end into a space; the state is the bytes of one unfinished character.
    """

    def __init__(self, bpe: Bpe, readable: bool = False):
        self.bpe, self.readable, self.gap = bpe, readable, ""
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        if self.readable:
            return "".join(map(self._text, ids))
        out = " ".join(map(self.bpe.token.__getitem__, ids))
        if out:
            out, self.gap = self.gap + out, " "
        return out

    def _text(self, i: int) -> str:
        token = self.bpe.token[i]
        if token in self.bpe.special:
            return self.end() + token
        ends = token.endswith(SUFFIX)
        out = self.utf8.decode(bytes(map(self.bpe.byte.__getitem__, token.removesuffix(SUFFIX) if ends else token)))
        return out + " " if ends else out

    def end(self) -> str:
        """What an unfinished character leaves."""
        out = self.utf8.decode(b"", True)
        self.utf8.reset()
        return out


@lru_cache(maxsize=4)
def load(file: str) -> Bpe:
    return Bpe(file)


def _coded(shared, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value)
        for batch in batches:
            counts, digests, decoded, lists = [], [], [], []
            for raw in batch.column(1):
                n, gap, machine, shown, all_ids = 0, "", Decoder(bpe, readable=full), [], []
                digest, told, words = hashlib.sha256(), hashlib.sha256(), bpe.found(raw.as_py() or "")
                while some := " ".join(islice(words, WORDS_AT_ONCE)):
                    digest.update((gap + some).encode())
                    gap, ids = " ", [int(i) for i in some.split(" ")]
                    n += len(ids)
                    text = machine.push(ids)
                    if full:
                        all_ids += ids
                        shown.append(text)
                    else:
                        told.update(text.encode())
                counts.append(n)
                digests.append(digest.hexdigest())
                decoded.append("".join([*shown, machine.end()]) if full else told.hexdigest())
                if full:
                    lists.append(all_ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["__id", "n_tokens", "ids_sha256", "decoded_text" if full else "decoded_sha256"]
            if full:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, full: bool = True) -> DataFrame:
    """``(id, n_tokens, ids_sha256, …)`` for every row: with ``full`` the ids and the decoded
    text, else only the digest of the decoding.

    A null or blank text has no tokens; a text may be of any length, and beyond the text itself and
    (with ``full``) its ids little is held. Ids that are null or repeat are kept as they are;
    further columns are ignored; an empty table gives no rows. ``path`` names the tokenizer
    file, which the driver reads and broadcasts: its size does not depend on the data.
    """
    with open(path or _default_file(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    last = "decoded_text string, ids array<int>" if full else "decoded_sha256 string"
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(_coded(shared, full), f"__id {kind}, n_tokens long, ids_sha256 string, {last}").withColumnRenamed("__id", id_col)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), full=False)


QUERIES = {"op9_bpe_codec": op9_bpe_codec}

ORACLES: dict[str, str] = {}
