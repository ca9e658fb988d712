"""Byte-pair encoding by forced boundaries, and its decoding.

A vocabulary whose tokens end words, over bytes. Two bytes that stand side by side inside no token can't be joined by any
merge, so a text may be cut between them beforehand: the pieces are encoded each by itself and laid end to end. A blank
is inside no token, so all blanks are such cuts, and pieces between blanks are encoded once for as long as they are
remembered. Inside a piece the tokenizer's own pattern cuts words, and forced boundaries cut words into fragments; only
the last fragment of a word takes the word's end. New pieces are cut, and new fragments merged, all of a batch at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from gridlore.llm.text import ship, whole

ship(__name__)

# Pieces, and fragments inside and at the end of words, each, that a task remembers, and how long one may be; code points of the texts that are encoded together.
REMEMBERED, SHORT, TOGETHER = 300_000, 64, 1_000_000
# Signs that stand for bytes lie below this code point.
SIGNS = 512
# Unicode's white space, and the signs that only str.split() takes for it.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NO_BLANKS = re.compile("[\x1c-\x1f]")


def read_vocabulary(path: str) -> str:
    """The tokenizer's file, to be sent to the tasks: they need no copy of their own."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _plain(spec: dict) -> re.Pattern | None:
    """The pattern that cuts words, for printable lower-case ASCII, whose signs stand for themselves; None for rules that
    do something else than lower-case letters and normalise signs beyond ASCII."""
    made = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if made != ["NFC", "Replace", "Lowercase"]:
        return None
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
        return None
    if steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    pattern = steps[0]["pattern"]["Regex"].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
    return None if r"\p" in pattern else re.compile(pattern)


def _counted(ends: np.ndarray, pieces: np.ndarray) -> np.ndarray | None:
    """How many words, by their ends, lie in each piece; None if a word goes on past its piece."""
    at = np.searchsorted(ends, pieces)
    return None if (at >= len(ends)).any() or (ends[at] != pieces).any() else np.diff(at + 1, prepend=0)


class Lists:
    """Lists of ids by number, laid end to end."""

    def __init__(self):
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def keep(self, n: int) -> None:
        """Keep the first n."""
        self.ends = self.ends[:n + 1].copy()
        self.flat = self.flat[:self.ends[-1]].copy()

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists end to end, and how many each has."""
        sizes = self.ends[numbers + 1] - self.ends[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[numbers] - (ends - sizes), sizes)], sizes


class Encoder:
    """The rules of one tokenizer file: a byte-level BPE with word ends."""

    def __init__(self, rules: str):
        spec = json.loads(rules)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("not a byte-level BPE")
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        # fragments inside a word don't take the word's end
        self.within = BPE(self.vocab, merges).tokenize
        self.last = BPE(self.vocab, merges, end_of_word_suffix=self.end).tokenize if self.end else self.within
        self.size = max(self.vocab.values()) + 1
        # the ids of signs, inside a word and at its end
        self.signs = np.zeros((2, SIGNS), np.int32)
        for c in self.vocab:
            if len(c) == 1:
                self.signs[:, ord(c)] = self.vocab[c], self.vocab.get(c + self.end, 0)
        # pairs that a merge joins, in order, each with its rank; by rank, the token that is made, and none at the end
        pairs = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in merges], np.int64)
        self.rank = np.argsort(pairs, kind="stable")
        self.pairs = np.append(pairs[self.rank], np.iinfo(np.int64).max)
        self.rank = np.append(self.rank, len(merges)).astype(np.int32)
        self.made = np.array([*(self.vocab[a + b] for a, b in merges), 0], np.int32)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens are taken as they are written")
        first = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, first)) + ")") if first else None
        self.inside = np.zeros((SIGNS, SIGNS), bool)
        for token in self.vocab:
            signs = np.frombuffer((token.removesuffix(self.end) if self.end else token).encode("utf-16-le"), np.uint16)
            self.inside[signs[:-1], signs[1:]] = True
        own = Tokenizer.from_str(rules)
        self.normalize, self.words = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.plain = _plain(spec)
        # what is remembered: numbers of pieces, and of fragments inside a word and of those that end one (many words share
        # them); a number's ids stand in one array, from a start on
        self.pieces: dict[str, int] = {}
        self.parts: tuple[dict[str, int], ...] = ({}, {})
        self.ids_of_pieces, self.ids_of_parts = Lists(), Lists()

    def _plain_words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of printable ASCII, in the signs that stand for bytes, by the pattern, found in all pieces at once if they fill
        them; and how many each piece has."""
        if not pieces:
            return [], np.zeros(0, np.int64)
        text = " ".join(pieces).lower()
        words = self.plain.findall(text)
        if "".join(words) == text.replace(" ", "") and not any(" " in w for w in words):
            counts = _counted(np.cumsum(list(map(len, words))), np.cumsum(list(map(len, pieces))))
            if counts is not None:
                return words, counts
        each = [self.plain.findall(p.lower()) for p in pieces]
        return list(chain.from_iterable(each)), np.array(list(map(len, each)))

    def _own_words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The same by the tokenizer's own rules. A blank composes with nothing, so pieces may stand side by side."""
        if not pieces:
            return [], np.zeros(0, np.int64)
        text = self.normalize(" ".join(pieces))
        signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        between = np.flatnonzero(signs == 32)
        if len(between) == len(pieces) - 1:
            found = self.words(text)
            which = np.searchsorted(between, np.array([at for _, (at, _) in found], np.int64))
            return [w for w, _ in found], np.bincount(which, minlength=len(pieces))
        each = [[w for w, _ in self.words(self.normalize(p))] for p in pieces]
        return list(chain.from_iterable(each)), np.array(list(map(len, each)))

    def fragments(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The words, in the signs that stand for bytes, cut where two bytes are inside no token; and which fragments end
        a word. Words hold no blank and aren't empty."""
        text = " ".join(words)
        signs = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        blank = signs == 32
        cut = np.flatnonzero(~(self.inside[signs[:-1], signs[1:]] | blank[:-1] | blank[1:])) + 1
        between = np.flatnonzero(blank)
        starts = np.concatenate(([0], cut, between + 1))
        ends = np.concatenate((cut, between, [len(text)]))
        order = np.argsort(starts)
        last = np.concatenate((np.zeros(len(cut), bool), np.ones(len(between) + 1, bool)))
        place = np.argsort(ends)
        return [text[a:b] for a, b in zip(starts[order].tolist(), ends[place].tolist())], last[place]

    def merge(self, fragment: str, ends: bool) -> list[int]:
        """A long fragment's ids by the library, which doesn't look at every pair for each merge."""
        return [t.id for t in (self.last if ends else self.within)(fragment)]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; as many as there are merges for a pair that none joins."""
        pair = a * np.int64(self.size) + b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.rank[at], self.rank[-1])

    def merged(self, fragments: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short fragments, end to end, and how many each has: of the pairs that a merge joins the one of least rank
        goes first, the leftmost of equals. Those of a length make their next merge together and then join the shorter ones."""
        sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
        starts, none = np.cumsum(sizes) - sizes, self.rank[-1]
        signs = np.frombuffer("".join(fragments).encode("utf-16-le"), np.uint16)
        last = np.zeros(len(signs), np.intp)
        last[(starts + sizes - 1)[ends]] = 1
        first = self.signs[last, signs]
        out, counts, held = np.zeros(len(signs), np.int32), sizes.copy(), None
        for n in range(int(sizes.max(initial=0)), 0, -1):
            who = np.flatnonzero(sizes == n)
            ids = first[starts[who][:, None] + np.arange(n)]
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            if held is not None:
                who, ids, ranks = (np.concatenate(x) for x in zip(held, (who, ids, ranks)))
            held, row = None, np.arange(len(who))
            at = ranks.argmin(1) if n > 1 else np.zeros(len(who), np.intp)
            least = ranks[row, at] if n > 1 else np.full(len(who), none)
            done = least == none
            out[starts[who[done]][:, None] + np.arange(n)] = ids[done]
            counts[who[done]] = n
            if done.all():
                continue
            who, ids, ranks, at, least = (x[~done] for x in (who, ids, ranks, at, least))
            row, later = np.arange(len(who)), np.arange(n - 1) > at[:, None]
            ids = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[row, at] = self.made[least]
            ranks = np.where(later[:, :-1] | (np.arange(n - 2) == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            ranks[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
            ranks[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])
            held = who, ids, ranks
        kept = np.arange(len(signs)) - np.repeat(starts, sizes) < np.repeat(counts, sizes)
        return out[kept], counts

    def _learn(self, pieces: list[str]) -> None:
        """Number new pieces and keep their ids, those of their fragments laid end to end."""
        if not pieces:
            return
        plain = [p for p in pieces if self.plain and p.isascii() and p.isprintable()]
        odd = [p for p in pieces if not (self.plain and p.isascii() and p.isprintable())]
        words, counts = (a + b if isinstance(a, list) else np.concatenate([a, b]) for a, b in zip(self._plain_words(plain), self._own_words(odd)))
        pieces = plain + odd
        fragments, ends = self.fragments(words) if words else ([], np.zeros(0, bool))
        number = np.empty(len(fragments), np.int64)
        long: list[tuple[str, bool]] = []
        for last, known in enumerate(self.parts):
            where = np.flatnonzero(ends == bool(last))
            own = [fragments[k] for k in where.tolist()]
            new = list(set(own).difference(known))
            short = [f for f in new if len(f) <= SHORT]
            self.ids_of_parts.add(*self.merged(short, np.full(len(short), bool(last))))
            known.update(zip(short, range(len(self.ids_of_parts) - len(short), len(self.ids_of_parts))))
            if len(short) < len(new):
                long += [(f, bool(last)) for f in new if len(f) > SHORT]
            number[where] = np.fromiter(map(known.get, own, repeat(-1)), np.int64, len(own))
        remembered = len(self.ids_of_parts)
        if long:
            ids = [self.merge(*f) for f in long]
            self.ids_of_parts.add(np.array(list(chain.from_iterable(ids)), np.int32), np.array(list(map(len, ids))))
            at = dict(zip(long, range(remembered, len(self.ids_of_parts))))
            for k in np.flatnonzero(number < 0).tolist():
                number[k] = at[fragments[k], bool(ends[k])]
        flat, sizes = self.ids_of_parts.take(number)
        self.ids_of_parts.keep(remembered)
        # by fragments, words and pieces, how many ids came up to there
        upto = np.concatenate(([0], np.cumsum(sizes)))
        words_end = np.concatenate(([0], np.flatnonzero(ends) + 1))
        pieces_end = np.concatenate(([0], np.cumsum(counts)))
        self.ids_of_pieces.add(flat, np.diff(upto[words_end[pieces_end]]))
        self.pieces.update(zip(pieces, range(len(self.ids_of_pieces) - len(pieces), len(self.ids_of_pieces))))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are encoded together, end to end, and how many each has: pieces that aren't remembered are
        encoded once."""
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
            self.ids_of_pieces.keep(0)
        if max(map(len, self.parts)) >= REMEMBERED:
            for known in self.parts:
                known.clear()
            self.ids_of_parts.keep(0)
        plan, ends = self._pieces(texts)
        coded = plan.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.pieces.get, unique, repeat(-1)), np.int64, len(unique))
        where = np.flatnonzero(numbers < 0)
        fresh = [unique[k] for k in where.tolist()]
        long = [p for p in fresh if len(p) > SHORT and p not in self.specials]
        given = [p for p in fresh if not p or p in self.specials]
        if given:
            ids = [self.specials[p] for p in given if p]
            self.ids_of_pieces.add(np.array(ids, np.int32), np.array([min(len(p), 1) for p in given]))
            self.pieces.update(zip(given, range(len(self.ids_of_pieces) - len(given), len(self.ids_of_pieces))))
        self._learn([p for p in fresh if 0 < len(p) <= SHORT and p not in self.specials])
        if long:
            remembered = len(self.ids_of_pieces)
            self._learn(long)
        numbers[where] = [self.pieces[p] for p in fresh]
        flat, sizes = self.ids_of_pieces.take(numbers[coded.indices.to_numpy()])
        if long:
            for p in long:
                del self.pieces[p]
            self.ids_of_pieces.keep(remembered)
        return flat, np.diff(np.concatenate(([0], np.cumsum(sizes)))[ends])

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """What lies between blanks, and special tokens, of all texts; and where each text's begin and the last one's end. A
        blank composes with nothing, so what lies between blanks may be normalised by itself."""
        if not any(_NO_BLANKS.search(t) or (self.special and self.special.search(t)) for t in texts):
            lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
            return lists.values, lists.offsets.to_numpy()
        plan: list[str] = []
        ends = [0]
        for text in texts:
            for part in self.special.split(text) if self.special else (text,):
                if part in self.specials:
                    plan.append(part)
                else:
                    plan += part.split() if not _NO_BLANKS.search(part) else [x for x in _BLANKS.split(part) if x]
            ends.append(len(plan))
        return pa.array(plan, pa.large_string()), np.array(ends)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that are encoded together."""
        flat, sizes = self.encode_flat(texts)
        ends, ids = np.cumsum(sizes).tolist(), flat.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def tokens(self) -> list[str | None]:
        """The token of each id."""
        both = {**self.vocab, **self.specials}
        out: list[str | None] = [None] * (max(both.values()) + 1)
        for token, k in both.items():
            out[k] = token
        return out


@lru_cache(maxsize=4)
def encoder(rules: str) -> Encoder:
    """The rules, built once in each Python worker."""
    return Encoder(rules)


def encode(docs: DataFrame, rules: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with out_col, the ids of its text as the tokenizer encodes it without special tokens of its own.

    A null text is an empty one and has no ids. Every row gets its result, rows that repeat as well; all columns are kept
    (text_col and out_col are free to choose; out_col must be new). An empty table gives no rows. A text is taken whole,
    however long: memory is the text, its ids, and REMEMBERED pieces of at most SHORT code points.
    """
    if out_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {out_col} already")
    at = next(k for k, c in enumerate(docs.columns) if c == text_col)
    schema = docs.select("*", F.array().cast("array<int>").alias(out_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rules)
        for batch in batches:
            start, texts, size = 0, [], 0
            for k, text in enumerate(batch.column(at), 1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= TOGETHER or k == batch.num_rows:
                    flat, sizes = own.encode_flat(texts)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, k - start).columns, lists], names=[*batch.schema.names, out_col])
                    start, texts, size = k, [], 0

    return docs.mapInArrow(run, schema)


def decoded(ids: Column, rules: str) -> Column:
    """The text of a list of ids: their tokens, special ones too, with a blank between any two, since the tokenizer names
    no decoder. Ids without a token are left out; null for a null list. The vocabulary is one constant."""
    tokens = encoder(rules).tokens()
    # no token holds a line break: it stands for itself as another sign
    named = F.split(F.lit("\n".join("" if t is None else t for t in tokens)), "\n")
    token = lambda k: F.nullif(F.get(named, k), F.lit(""))
    return F.array_join(F.transform(ids, token), " ")
