"""Word-level byte-pair encoding without replaying merges.

A word's encoding is found by dynamic programming over its prefixes. Every prefix of a word has exactly
one encoding, hence exactly one last token; the table of last tokens is filled from left to right:

* an automaton over the vocabulary lists all tokens that end at a position (the suffix matches);
* a candidate is right if it may stand behind the last token of the prefix it starts at, which a
  compatibility test on the *pair* of tokens decides;
* back-pointers through the table then give the ids.

Cost is linear in the word for a fixed vocabulary, with no priority queue and no quadratic merge loop.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import regex

WORD_END = "</w>"
#: Stands behind a word's last character inside the automaton. Byte-level text has no character below "!".
MARK = "\x00"
INF = 1 << 60
#: Bounds of the per-worker memo tables; a full table is emptied (words: in two generations), which costs time and never results.
MAX_WORDS, MAX_PAIRS = 400_000, 1_000_000


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character, by the public byte-level rule: printable Latin-1 stays, the rest moves to 256 and up."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in stay}
    moved = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + k) for k, b in enumerate(moved)}


class PrefixBpe:
    """Encodes one word at a time, given the vocabulary and merge list of a tokenizer file with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("a BPE file with word ends is expected")
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, merged id)
        self.parts: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = (self.vocab[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            made = self.vocab[self.text_of[left] + self.text_of[right]]
            self.rank.setdefault((left, right), (r, made))
            self.parts.setdefault(made, (left, right))
        self.born = {t: self.rank[p][0] for t, p in self.parts.items()}  # base symbols are born before all merges
        self.to_symbols = {b: ord(c) for b, c in byte_alphabet().items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list[int]] = {}
        self.whole: dict[int, bool] = {}
        self.found = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            if self.is_whole(i):
                key = t[: -len(WORD_END)] + MARK if t.endswith(WORD_END) and len(t) > len(WORD_END) else t
                self.found.add_word(key, (i, len(key) - 1))
        self.found.make_automaton()

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one edge of `token` while it is being built, smallest first. side: 0 left, 1 right."""
        if (known := self.spines.get((token, side))) is None:
            known, at = [token], token
            while at in self.parts:
                at = self.parts[at][side]
                known.append(at)
            known.reverse()
            self.spines[token, side] = known
        return known

    def boundary_holds(self, left: int, right: int, until: int = INF) -> bool:
        """Whether no merge of rank below `until` crosses the border while both tokens are being built.

        Both edges grow in the order of merge ranks. The border falls if, while two edge tokens meet, their own
        merge comes before the next growth of either; on equal ranks the merge that starts further left is first.
        """
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            cross = self.rank.get((a[i], b[j]), (INF, 0))[0]
            grow_a = self.born[a[i + 1]] if i + 1 < len(a) else INF
            grow_b = self.born[b[j + 1]] if j + 1 < len(b) else INF
            if cross < until and cross < grow_a and cross <= grow_b:
                return False
            if grow_a == grow_b == INF:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def is_whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as this token; only such tokens can occur in an encoding."""
        if (known := self.whole.get(token)) is None:
            if token not in self.parts:
                known = True
            else:
                left, right = self.parts[token]
                known = self.is_whole(left) and self.is_whole(right) and self.boundary_holds(left, right, self.born[token])
            self.whole[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.boundary_holds(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (as the pre-tokenizer cuts it, without white space)."""
        symbols = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_symbols)
        n = len(symbols)
        if n == 0:
            return []
        # last[k]: last token of the prefix that ends in symbol k - 1; the marked end takes the place of symbol n
        last, start, pairs = [-1] * (n + 2), [0] * (n + 2), self.pairs
        for end, (token, back) in self.found.iter(symbols + MARK):
            if last[end + 1] < 0:
                begin = end - back
                if begin:
                    left = last[begin]
                    if left < 0:
                        continue
                    if (fits := pairs.get((left, token))) is None:
                        fits = self.fits(left, token)
                    if not fits:
                        continue
                last[end + 1], start[end + 1] = token, begin
        ids, at = [], n + 1
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"no encoding ends at {at} of {word!r}")
            ids.append(last[at])
            at = start[at]
        return ids[::-1]


class Memo(dict):
    """word -> little-endian 32-bit ids. When full, one older generation stays readable, so frequent words survive."""

    def __init__(self, of_word: Callable[[str], list[int]]):
        super().__init__()
        self.of_word, self.old = of_word, {}

    def __missing__(self, word: str) -> bytes:
        if (got := self.old.get(word)) is None:
            got = np.array(self.of_word(word), dtype="<u4").tobytes()
        if len(self) >= MAX_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


def latin(kind: str) -> str:
    """The Latin characters from U+00A1 to U+024F of a Unicode property, for a character class."""
    return "".join(c for c in map(chr, range(0xA1, 0x250)) if regex.match(kind, c))


class TextEncoder:
    """Ids of whole texts, exactly as the tokenizers library gives them with add_special_tokens=False.

    `of_word` gives a word's ids: PrefixBpe.encode_word, or a call of the library. Texts of plain Latin
    characters are cut by an equal of the file's own pattern that names its characters; in other texts each
    white-space separated chunk with any other character goes through the library's normaliser and
    pre-tokenizer, whose Unicode tables then decide. Words never cross white space, so chunks are independent.
    """

    #: The pattern that this class cuts by; a file with another one is cut by the library alone.
    KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*\Z")

    def __init__(self, path: str, of_word: Callable[[str], list[int]] | None = None):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        known = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"]][0] == self.KNOWN
        letters, digits = latin(r"\p{L}"), latin(r"\p{N}")
        self.plain = self.PLAIN.match if known else lambda text: None
        self.words_of = re.compile(f"[a-z{letters}]+|'(?:[stmd]|re|ve|ll)|[0-9{digits}]|[^\\sa-z0-9{letters}{digits}]+").findall
        self.special = {a["content"]: np.array([a["id"]], dtype="<u4").tobytes() for a in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.text_of = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.from_bytes = {ord(c): b for b, c in byte_alphabet().items()}
        self.to_symbols = byte_alphabet()
        self.memo = Memo(of_word or self.library_word)

    def library_word(self, word: str) -> list[int]:
        """Ids of a word by the library's model alone: its text is normalised, and doing so twice may reorder marks."""
        return [t.id for t in self.library.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_symbols))]

    def chunk(self, chunk: str) -> bytes:
        if self.plain(chunk):
            words = self.words_of(chunk.lower())
        else:
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            words = [w.translate(self.from_bytes).encode("latin-1").decode("utf-8") for w, _ in cut]
        return b"".join(map(self.memo.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text; special strings in it are one token each, as by the library's default."""
        if "<|" in text and len(parts := self.cut(text)) > 1:
            return b"".join([self.special[p] if p in self.special else self.encode(p) for p in parts])
        if self.plain(text):
            return b"".join(map(self.memo.__getitem__, self.words_of(text.lower())))
        return b"".join([self.chunk(c) for c in text.replace("\n", " ").split(" ") if c])

    def decode(self, ids: bytes) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives: this file has no decoder, so tokens joined by a space."""
        return " ".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_BUILT: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, kind: str) -> TextEncoder:
    """One encoder a worker process. kind: "prefix" (dynamic programming) or "library"."""
    if (path, kind) not in _BUILT:
        _BUILT[path, kind] = TextEncoder(path, PrefixBpe(path).encode_word if kind == "prefix" else None)
    return _BUILT[path, kind]
