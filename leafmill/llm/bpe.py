"""BPE encoding and decoding by a traversal of the trie of distinct words.

The last token of a prefix's encoding decides it: dropping that token leaves the encoding of a shorter prefix.
So the distinct words of a slice of text go, sorted, through a depth-first walk of their trie that keeps for
each depth the last token and where it begins; what words share at their beginning is worked out once.
The tokens that may be the last of a prefix are those that end there, which one step of a trie of the vocabulary
gives; one may follow another if no merge across their border would have come before the merges inside them.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from leafmill.llm.common import batch, id_and_text, slices, strings

#: Texts with other code points are split by the tokenizers library itself, whose Unicode tables may be older or newer.
UNSURE = regex.compile(r"[^\u0000-\u0557\u2000-\u206f]")
#: Code points of text whose words are held at once, and words whose encodings a worker keeps from slice to slice; a slice's own are all held.
SLICE, KEPT_WORDS = 1 << 21, 200_000
#: Pairs of tokens of which a worker keeps whether they may stand together.
KEPT_PAIRS = 1_000_000
#: How files of this kind split text, and the letter that stands for a word's end here.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "\n"
#: A longer word (in byte-level letters) gets a walk of its own, which keeps no encoding of every prefix.
LONG = 128


def letter_class(pattern: str) -> str:
    """What of the code points outside ``UNSURE`` matches, as ranges of a character class."""
    good = [i for i in range(0x2070) if not UNSURE.match(chr(i)) and regex.match(pattern, chr(i))]
    starts = [i for i in good if i - 1 not in set(good)]
    ends = [i for i in good if i + 1 not in set(good)]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


_L, _N, _S = map(letter_class, (r"\p{L}", r"\p{N}", r"\s"))
#: The same split for such code points; letters come first, as most words are.
WORDS = re.compile(rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class State(dict):
    """The longest end of what was read that begins a token, and by letter the state after it.

    ``ending``: the tokens that end here as (length, id), longest first.  A step that the tokens' own trie
    doesn't have goes on from the next shorter end; it is worked out when it is first taken.
    """

    __slots__ = ("ending", "shorter")

    def __missing__(self, letter: str) -> State:
        following = self[letter] = self if self.shorter is None else self.shorter[letter]
        return following


def suffix_trie(tokens: Iterable[tuple[str, int]]) -> State:
    """The state before any letter, of a trie that gives all tokens that end at a place by one step for each letter."""
    start = State()
    start.ending, start.shorter = (), None
    own: dict[int, tuple[int, int]] = {}
    for token, number in tokens:
        state = start
        for letter in token:
            following = dict.get(state, letter)
            if following is None:
                following = state[letter] = State()
            state = following
        own[id(state)] = len(token), number
    # by growing depth: the state of what is left without the first letter is known before
    todo: list[tuple[State, str, State]] = [(start, letter, state) for letter, state in start.items()]
    for parent, letter, state in todo:
        todo += [(state, x, child) for x, child in state.items()]
        state.shorter = start if parent is start else parent.shorter[letter]
        ending = state.shorter.ending
        state.ending = (own[id(state)], *ending) if id(state) in own else ending
    return start


class WordBPE:
    """A tokenizers file of kind BPE with word ends, byte-level letters and lower-cased, split input."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or split["behavior"] != "Removed" or split["pattern"]["Regex"] != SPLIT:
            raise ValueError(f"{path} isn't of the kind that this encoder knows")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.unspelled = {ord(letter): byte for byte, letter in self.letters.items()}
        # of each pair its rank; of each token that a merge made, that rank and the two parts
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault((a, b), r)
            self.made.setdefault(a + b, (r, a, b))
        self.bytes_of = {i: np.uint32(i).astype("<u4").tobytes() for i in self.names}
        spelled = [(t.removesuffix(self.end) + END if t.endswith(self.end) else t, i) for t, i in self.vocab.items()]
        self.trie = suffix_trie(spelled)
        #: Whether a token may follow another, by their ids, as far as it was asked; -1 stands for the word's beginning.
        self.may_follow: dict[int, dict[int, bool]] = {i: {} for i in self.vocab.values()}
        self.may_follow[-1] = {i: self._is_whole(t) for t, i in self.vocab.items()}
        self.asked = 0
        #: Encoding and decoded text of words: those of late, and those from before.
        self.known: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}

    def _is_whole(self, token: str) -> bool:
        """Whether the token's own letters encode to it: its parts do, and may not meet otherwise."""
        todo = [token]
        while todo:
            t = todo.pop()
            if t in self.made:
                r, a, b = self.made[t]
                if not self._border(a, b, r):
                    return False
                todo += [a, b]
            elif len(t.removesuffix(self.end)) != 1:
                return False
        return True

    def _border(self, a: str, b: str, limit: float) -> bool:
        """True if no merge across the border of a and b comes before ``limit`` and before their own merges.

        Of the two the one made later is undone, again and again; at each state a merge of what touches the
        border would win if its rank is lower than that of the merge just undone, or equal and further left.
        """
        rank, made = self.rank, self.made
        base = (-1, "", "")
        strict = True
        while True:
            r = rank.get((a, b))
            if r is not None and (r < limit or (not strict and r == limit)):
                return False
            made_a, made_b = made.get(a, base), made.get(b, base)
            if made_a[0] > made_b[0]:
                limit, a, strict = made_a[0], made_a[2], True
            elif made_b[0] >= 0:
                limit, b, strict = made_b[0], made_b[1], False
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may follow token a, kept in ``may_follow``."""
        self.asked += 1
        if self.asked > KEPT_PAIRS:
            self.asked = 0
            for i, row in self.may_follow.items():
                if i >= 0:
                    row.clear()
        found = self.may_follow[a][b] = self._border(self.names[a], self.names[b], float("inf"))
        return found

    def normal(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() looks at its neighbours, the tokenizer doesn't
                text = text.replace("Σ", "σ")
        return text.lower()

    def spelled(self, word: str) -> str:
        """In byte-level letters."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def learn(self, words: set[str]) -> None:
        """Encode distinct words that aren't known yet, walking their trie depth first.

        Of each prefix on the path stand its state, its last token, what may follow that, and where that token begins.
        """
        bytes_of, names, known = self.bytes_of, self.names, self.known
        states, last, rows, begins = [self.trie] * (LONG + 1), [-1] * (LONG + 1), [self.may_follow[-1]] * (LONG + 1), [0] * (LONG + 1)
        path, depth = "", 0
        for spelling, word in sorted([(self.spelled(w), w) for w in words]):
            n = len(spelling)
            if n > LONG:
                tokens = self.long_word(spelling)
                known[word] = b"".join([bytes_of[t] for t in tokens]), " ".join([names[t] for t in tokens])
                continue
            shared, most = 0, min(depth, n - 1)
            while shared < most and path[shared] == spelling[shared]:
                shared += 1
            state = states[shared]
            for d in range(shared + 1, n):
                state = state[spelling[d - 1]]
                for size, token in state.ending:
                    ok = rows[d - size].get(token)
                    if ok or (ok is None and self.follows(last[d - size], token)):
                        break
                else:
                    raise AssertionError(f"no token ends {spelling[:d]!r}")
                states[d], last[d], rows[d], begins[d] = state, token, self.may_follow[token], d - size
            # the word's end counts as a letter more
            for size, token in state[spelling[n - 1]][END].ending:
                d = n + 1 - size
                ok = rows[d].get(token)
                if ok or (ok is None and self.follows(last[d], token)):
                    break
            else:
                raise AssertionError(f"no token ends {spelling!r}")
            ids, said = bytes_of[token], names[token]
            while d:
                token = last[d]
                ids, said, d = bytes_of[token] + ids, f"{names[token]} {said}", begins[d]
            known[word] = ids, said
            path, depth = spelling, n - 1

    def long_word(self, spelling: str) -> list[int]:
        """Tokens by the same walk along one word: last tokens forward, then back along them."""
        state, last, begins = self.trie, [-1], [0]
        for d, letter in enumerate((*spelling, END), 1):
            state = state[letter]
            for size, token in state.ending:
                at = last[d - size]
                ok = self.may_follow[at].get(token)
                if ok or (ok is None and self.follows(at, token)):
                    break
            else:
                raise AssertionError("no token ends a prefix of a long word")
            last.append(token)
            begins.append(d - size)
        found, d = [], len(last) - 1
        while d:
            found.append(last[d])
            d = begins[d]
        return found[::-1]

    def plain_words(self, text: str) -> list[str]:
        if text.isascii() or not UNSURE.search(text):
            return WORDS.findall(self.normal(text))
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [piece.translate(self.unspelled).encode("latin-1").decode() for piece, _ in pieces]

    def words(self, text: str) -> list[str]:
        """Words of a text; special tokens' strings stand as they are."""
        if "<|" not in text:
            return self.plain_words(text)
        out: list[str] = []
        for part in self.special_pattern.split(text):
            out += [part] if part in self.special else self.plain_words(part)
        return out

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit, decoded text) of each."""
        at = 0
        while at < len(texts):
            size, upto = 0, at
            while upto < len(texts) and (size == 0 or size + len(texts[upto]) <= SLICE):
                size, upto = size + len(texts[upto]) + 1, upto + 1
            split = [self.words(t) for t in texts[at:upto]]
            known = self.encoded(set().union(*split))
            for words in split:
                found = [*map(known.__getitem__, words)]
                yield b"".join([f[0] for f in found]), " ".join([f[1] for f in found])
            at = upto

    def encoded(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        """Encoding and decoded text of distinct words."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            # the words of late become those from before; those of this call are all held, however many
            self.known, self.before, new = {}, self.known, words
        again = {w: found for w in new if (found := self.before.get(w)) is not None}
        self.known |= again | {t: (self.bytes_of[i], self.names[i]) for t, i in self.special.items()}
        self.learn(new.difference(self.known))
        out = {w: self.known[w] for w in words}
        for w in words:
            if len(w) > LONG:
                self.known.pop(w)
        return out


_encoders: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = WordBPE(path)
    return _encoders[path]


ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``with_ids`` ids and decoded.

    Null and empty texts have no tokens; repeated rows give repeated results, null ids stay null; an empty table gives none.  Very long texts are
    encoded whole, in the task that reads them.
    """
    schema = pa.schema([*ROWS, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]) if with_ids else ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_file)
        for b in slices(batches):
            out: list[list] = [[] for _ in range(len(schema) - 1)]
            for ids, text in bpe.encode_all(strings(b.column("text"))):
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                row += [np.frombuffer(ids, "<u4").astype(np.int32), text] if with_ids else []
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield batch(schema, [b.column("doc_id"), *out])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)


def decode_ids(encoded: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) from a column of ids; null ids decode to an empty text, ids that the file doesn't have to nothing."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = encoder(tokenizer_file).names
        schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])
        for b in batches:
            yield batch(schema, [b.column("doc_id"), [" ".join([names[i] for i in ids or () if i in names]) for ids in b.column("ids").to_pylist()]])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded string")
