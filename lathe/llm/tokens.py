"""Token ids of whole texts with a public tokenizer, memoised by piece.

Both supported tokenizer kinds cut text before merging: at white space, and between a letter and a
full stop or comma. A text's ids are therefore the ids of its pieces in a row when it is cut
before single blanks, around single line feeds, and before a full stop or comma that follows a letter or digit (only
Latin letters and ASCII digits, whose classes no Unicode version changes). Texts where a cut would not be of
these kinds (runs of white space, "..", special tokens' strings) are cut at sure places only, or
encoded whole. Each worker keeps a bounded memo of pieces; when it is full, pieces met once are forgotten.

One kind (`apart`, recognised by its file's settings) drops white space and lower-cases. Its texts are cut at ASCII white space
and between an ASCII or Latin letter or digit and a full stop or comma, in Arrow: no other text needs care, and only a
slice's different pieces become Python strings. New pieces of Latin letters are lower-cased and go to the model as words.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .text import ints

from .held import held

MEMO = 400_000  # pieces a worker keeps
WHOLE = "\x01"  # begins keys of chunks outside the usual cuts
CUT = "\x02"  # stands at the cuts of a text
PLAIN, SOFT, BLANK, FEED = range(4)  # how a piece begins: otherwise, with a stop or comma, with a blank; a line feed

LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"  # letters in every Unicode version, composed, lower case letter by letter (İ is not)
LETTERS = re.compile(f"[{LATIN}]+")
SURE = f"([0-9{LATIN}])([.,])"
# white space only separates, letters and other signs never share a word, words are lower-cased
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def is_apart(spec: dict) -> bool:
    """Whether a tokenizer file's settings are those of the kind that `APART` describes, with no special token a cut could split."""
    model = spec["model"]
    return ({k: spec.get(k) for k in APART} == APART and model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"[\s.,]", t["content"]) or LETTERS.fullmatch(t["content"])
                        for t in spec["added_tokens"]))


class _Memo(dict):
    """Key -> number; new keys are numbered and queued."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Encoder:
    """Ids of many texts at once: `encode(texts)` -> (ids, offsets), `end` appended to each text."""

    def __init__(self, path: str, end: int | None, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a mark that ends a piece and is one id of its own, to encode many pieces in one call
        self.mark, self.mark_id = None, None
        for mark in ("\n", " |"):
            apart = [x.tolist() for x in self._plain(["a", " b", mark, f"a{mark} b{mark}a{mark}"])]
            if len(apart[2]) == 1 and apart[3] == apart[0] + apart[2] + apart[1] + apart[2] + apart[0] + apart[2]:
                self.mark, self.mark_id = mark, apart[2][0]
                break
        self.apart = False
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if self.mark is not None and is_apart(spec):
            self.apart = True
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
            self.last[[n for token, n in vocabulary.items() if token.endswith(suffix)]] = True
        self.end, self.limit = end, memo
        self.memo = _Memo()
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.tables = {"begin": np.zeros(1 << 12, np.int64), "size": np.zeros(1 << 12, np.int32), "uses": np.zeros(1 << 12, np.int64),
                       "kind": np.zeros(1 << 12, np.int8), "word": np.zeros(1 << 12, bool), "odd": np.zeros(1 << 12, bool)}

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _store(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), dtype=np.uint32)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.tables["begin"][numbers] = self.used + np.cumsum(sizes) - sizes
        self.tables["size"][numbers] = sizes
        self.used += len(ids)

    def _store_joined(self, numbers: list[int], pieces: list[str]) -> None:
        """Encode many pieces in one call, marks between them."""
        between = self.mark + " " if self.apart else self.mark
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(pieces) + self.mark], add_special_tokens=False)[0].ids, dtype=np.uint32)
        marks = ids == self.mark_id
        at = np.flatnonzero(marks)
        if len(at) == len(pieces):
            self._store(numbers, ids[~marks], np.diff(at, prepend=-1) - 1)
        else:
            self._store_each(numbers, pieces)

    def _store_each(self, numbers: list[int], pieces: list[str]) -> None:
        coded = self._plain(pieces)
        self._store(numbers, np.concatenate(coded), np.array([len(x) for x in coded]))

    def _store_words(self, numbers: np.ndarray, words: list[str]) -> None:
        """Encode many lower-case words of Latin letters in one call; each ends with the one id that ends words."""
        ids = np.array(self.words.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.uint32)
        at = np.flatnonzero(self.last[ids])
        if len(at) == len(words) and at[-1] == len(ids) - 1:
            self._store(numbers, ids, np.diff(at, prepend=-1))
        else:
            self._store_each(numbers, words)

    def _room(self) -> None:
        """Let the tables hold all numbered keys."""
        if len(self.memo) > len(self.tables["begin"]):
            for name, old in self.tables.items():
                fresh = np.zeros(2 * len(self.memo), dtype=old.dtype)
                fresh[:len(old)] = old
                self.tables[name] = fresh

    def _learn_apart(self, n: int, new: pa.Array, keys: list[str]) -> None:
        """Ids of the new pieces numbered from `n` on; those of Latin letters share the ids of their lower-case word."""
        self._room()
        self.tables["uses"][n:n + len(keys)] = 0
        letters = pc.match_substring_regex(new, f"^[{LATIN}]+$")
        low = pc.dictionary_encode(pc.utf8_lower(new.filter(letters)))
        words, inner = low.dictionary.to_numpy(zero_copy_only=False).tolist(), ints(low.indices)
        is_word = np.asarray(letters)
        pieces = n + np.flatnonzero(is_word)
        source = np.zeros(len(words), dtype=np.int64)
        source[inner[::-1]] = pieces[::-1]  # a word's first piece, or the word itself if it was met before
        known = np.fromiter(map(self.memo.get, words, repeat(n)), dtype=np.int64, count=len(words))
        source = np.where(known < n, known, source)
        todo = np.flatnonzero(known >= n).tolist()
        for at in range(0, len(todo), 1024):
            some = todo[at:at + 1024]
            self._store_words(source[some], [words[i] for i in some])
        for name in ("begin", "size"):
            self.tables[name][pieces] = self.tables[name][source[inner]]
        special = any(s in "\n".join(keys) for s in self.special)
        sure, other = [], []
        for i in np.flatnonzero(~is_word).tolist():
            (other if self.mark[-1] in keys[i] or special and any(s in keys[i] for s in self.special) else sure).append(i)
        for at in range(0, len(sure), 64):
            some = sure[at:at + 64]
            self._store_joined([n + i for i in some], [keys[i] for i in some])
        for at in range(0, len(other), 1024):
            some = other[at:at + 1024]
            self._store_each([n + i for i in some], [keys[i] for i in some])

    def _learn(self) -> None:
        new, self.memo.new = self.memo.new, []
        if not new:
            return
        n = len(self.memo) - len(new)
        self._room()
        special = any(s in "\n".join(new) for s in self.special)  # seldom, so looked for in all keys at once
        kind, word, odd = [], [], []
        begins = {" ": BLANK, ".": SOFT, ",": SOFT}
        for key in new:
            first, last = key[:1], key[-1:]
            if first == WHOLE or key == "\n":
                kind.append(PLAIN if first == WHOLE else FEED)
                word.append(False)
                odd.append(False)
                continue
            kind.append(begins.get(first, PLAIN))
            word.append(last < "\u0250" and (last.isalpha() or "0" <= last <= "9"))
            inner = key[1:2] if first == " " else first  # a piece of a blank and more white space, or of nothing, is odd
            odd.append(not inner or inner.isspace() or last.isspace() or special and any(s in key for s in self.special))
        where = slice(n, n + len(new))
        self.tables["kind"][where], self.tables["word"][where], self.tables["odd"][where], self.tables["uses"][where] = kind, word, odd, 0
        sure, other = [], []
        for i, key in enumerate(new):
            (other if self.mark is None or key[0:1] == WHOLE or odd[i] or self.mark[-1] in key else sure).append(i)
        for at in range(0, len(sure), 64):
            some = sure[at:at + 64]
            self._store_joined([n + i for i in some], [new[i] for i in some])
        for at in range(0, len(other), 1024):
            some = other[at:at + 1024]
            self._store_each([n + i for i in some], [new[i].removeprefix(WHOLE) for i in some])

    def _ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered pieces in a row, where each piece's end)."""
        sizes = self.tables["size"][which].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.tables["begin"][which] - (ends - sizes), sizes) + np.arange(total)], ends

    def _forget(self) -> None:
        """Keep the pieces met more than once (none, if those alone fill half the memo)."""
        keys = list(self.memo)
        keep = np.flatnonzero(self.tables["uses"][:len(keys)] > 1)
        if 2 * len(keep) > self.limit:
            keep = keep[:0]
        ids, ends = self._ids(keep)
        memo = _Memo()
        for n, k in enumerate(keep.tolist()):
            dict.__setitem__(memo, keys[k], n)
        self.memo, self.used = memo, len(ids)
        self.ids[:len(ids)] = ids
        for name, old in self.tables.items():
            old[:len(keep)] = old[keep]
        self.tables["begin"][:len(keep)] = ends - self.tables["size"][:len(keep)]
        self.tables["uses"][:] = 0

    def _careful(self, text: str) -> list[str]:
        """Keys of a text without the usual cuts."""
        if any(s in text for s in self.special):
            return [WHOLE + text]
        pieces = text.split(" ")
        chunks = [pieces[0]]
        for before, piece in zip(pieces, pieces[1:]):
            if before and piece and not before[-1].isspace() and not piece[0].isspace():
                chunks.append(" " + piece)
            else:
                chunks[-1] += " " + piece
        return [WHOLE + c for c in chunks]

    def _unsure(self, which: np.ndarray, bounds: np.ndarray) -> set[int]:
        """Texts that have a cut of another kind than the usual ones."""
        kind = self.tables["kind"][which]
        feed = kind[:-1] == FEED
        bad = np.concatenate([[False], (kind[1:] == SOFT) & ~self.tables["word"][which[:-1]] | feed & (kind[1:] >= BLANK)]) if len(which) else np.zeros(0, bool)
        bad[bounds[:-1][bounds[:-1] < len(bad)]] = False  # a text's first piece follows nothing
        found = np.flatnonzero(bad | self.tables["odd"][which])
        return set((np.searchsorted(bounds, found, "right") - 1).tolist())

    def _cut_apart(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts' pieces in a row, where each text's pieces begin)."""
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(texts.fill_null(""), SURE, r"\1 \2"))
        coded = pc.dictionary_encode(cut.flatten())
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.memo.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        fresh, n = np.flatnonzero(numbers < 0), len(self.memo)
        if len(fresh):
            new = [keys[i] for i in fresh.tolist()]
            numbers[fresh] = np.arange(n, n + len(new))
            self.memo.update(zip(new, range(n, n + len(new))))
            self._learn_apart(n, coded.dictionary.take(pa.array(fresh)), new)
        inner = ints(coded.indices)
        self.tables["uses"][numbers] += np.bincount(inner, minlength=len(keys))
        bounds = ints(cut.offsets)
        return numbers[inner], bounds - bounds[0]

    def _cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts' pieces in a row, where each text's pieces begin)."""
        careful = {i for i, t in enumerate(texts) if t and (CUT in t or WHOLE in t)}
        while True:
            keys: list[str] = []
            counts = np.zeros(len(texts), dtype=np.int64)
            for i, text in enumerate(texts):
                if text:
                    if i in careful:
                        cut = self._careful(text)
                    else:
                        cut = text.replace(" ", CUT + " ").replace(",", CUT + ",").replace(".", CUT + ".").replace("\n", CUT + "\n" + CUT).split(CUT)
                    keys += cut
                    counts[i] = len(cut)
            which = np.fromiter(map(self.memo.__getitem__, keys), dtype=np.int64, count=len(keys))
            self._learn()
            bounds = np.concatenate([[0], np.cumsum(counts)])
            unsure = self._unsure(which, bounds) - careful
            if not unsure:
                break
            careful |= unsure
        self.tables["uses"][:len(self.memo)] += np.bincount(which, minlength=len(self.memo))
        return which, bounds

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.limit:
            self._forget()
        if self.apart:
            which, bounds = self._cut_apart(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        else:
            which, bounds = self._cut(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
        ids, ends = self._ids(which)
        lengths = np.concatenate([[0], ends])[bounds]
        if self.end is None:
            return ids, lengths
        offsets = lengths + np.arange(len(texts) + 1)
        out = np.full(len(ids) + len(texts), self.end, dtype=np.uint32)
        body = np.ones(len(out), dtype=bool)
        body[offsets[1:] - 1] = False
        out[body] = ids
        return out, offsets


def encoder(path: str, end: int | None) -> Encoder:
    """The worker's encoder for a tokenizer file (kept between tasks, until another operator needs the memory)."""
    return held(("encoder", path, end), lambda: Encoder(path, end))
