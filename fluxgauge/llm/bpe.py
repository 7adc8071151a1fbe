"""BPE encoding and decoding as streaming transducers.

Encoding reads a word's symbols one by one. BPE has two properties (shown for merge lists in which
every token encodes to itself, which is checked for each token used):

* a sequence of tokens is the encoding of its string exactly if every two neighbours are the
  encoding of theirs, so that the last token of a prefix's encoding is the only token that ends
  there and stands rightly beside the last token of what comes before it;
* the encoding of a string cut at one of its token borders is the encoding of both parts.

An Aho-Corasick automaton of the tokens lists what ends at each place, the longest first. So for every
place the transducer finds one token and where it began. A later token begins at most `lookahead`
symbols before its end, which the merge list bounds: what all of the last `lookahead` places have in
common of their chains can no longer change, is emitted and forgotten. Memory is that window, however
long a word is; texts are normalised and split some `SEGMENT` characters at a time, so beside the text
itself only a bounded number of its tokens is held. (A text without white space is normalised whole.)

Decoding is a state machine that ids are fed to: either it feeds their bytes to an incremental UTF-8
decoder, or it gives their written forms as the tokenizers library does for a file without a decoder,
which joins them by spaces. `digests` hashes ids and what they decode to as they come.

The files' rules around the merges (normalisation, splitting, added tokens, a suffix on the last
symbol of a word) are the library's. Null and empty texts have no tokens. Rows with equal texts or
ids have equal results each; an empty table gives no rows. Columns other than id and text play no
part, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import Memory, per_text

#: Chunks and words whose encodings a worker remembers, and token pairs.
CACHE_CHUNKS, CACHE_WORDS, CACHE_PAIRS = 120_000, 150_000, 500_000
#: Characters of a word that are read at once, and places kept before settled tokens leave.
BLOCK = 2048
#: Characters of a text that are normalised and split at once, and of the longest chunk that is remembered.
SEGMENT, REMEMBERED = 1 << 16, 64
#: Stands for the end-of-word suffix after a word's last character.
END = "\0"
#: Unicode's white space.
CONTROL = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def written_bytes() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)}


NEVER = 1 << 30


class Vocabulary:
    """Tokens, merges and splitting rules of a tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path}: only plain BPE files without decoder and post-processor")
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: r for r, m in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, octets = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or octets["type"] != "ByteLevel":
            raise ValueError(f"{path}: unknown normaliser or splitter")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE.pattern[1:-2]))
        self.byte = written_bytes()
        self._last: dict[str, tuple[str, str, int] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self.mark = END if self.end else ""
        self.lookahead = sufficient_lookahead(merges, self.end)
        self.names = {i: str(i) for i in self.texts}
        #: Of a token the tokens that were tried at its right, and whether they stand rightly there; and how many in all.
        self.right: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.tried = 0
        self.matches = self._automaton()

    def symbols(self, token: str) -> list[str]:
        """A token's symbols: characters, the suffix being part of the last."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            stem = token[: -len(self.end)]
            return [*stem[:-1], stem[-1] + self.end]
        return list(token)

    def _automaton(self) -> ahocorasick.Automaton:
        """Finds all tokens that end at a character, with their lengths; an end of word counts as a character."""
        out = ahocorasick.Automaton()
        for token, i in self.ids.items():
            ends = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            written = token[: -len(self.end)] + END if ends else token
            out.add_word(written, (len(written), i))
        out.make_automaton()
        return out

    def last_merge(self, token: str) -> tuple[str, str, int] | None:
        """The merge, with its rank, that completes a token; None for a symbol."""
        if token not in self._last:
            out, last = self.symbols(token), None
            while len(out) > 1:
                rank, at = min((self.ranks.get(p, NEVER), k) for k, p in enumerate(zip(out, out[1:], strict=False)))
                if rank == NEVER:
                    raise ValueError(f"the token {token!r} does not encode to itself")
                last = out[at], out[at + 1], rank
                out[at : at + 2] = [out[at] + out[at + 1]]
            self._last[token] = last
        return self._last[token]

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at the token's left (0) or right (1) edge as it is merged, and the rank of the merge that ends it."""
        if (known := self._edges[side].get(token)) is None:
            last = self.last_merge(token)
            if last is None:
                known = [(token, NEVER)]
            else:
                inner = self.edge(last[side], side)
                known = [*inner[:-1], (inner[-1][0], last[2]), (token, NEVER)]
            self._edges[side][token] = known
        return known

    def beside(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' string is the two.

        Merges come by rank, the leftmost first: follow both edges at the border through the
        merges until a merge across it would come first.
        """
        if (known := self.right[a].get(b)) is None:
            if self.tried >= CACHE_PAIRS:
                self.right.clear()
                self.tried = 0
            left, right = self.edge(self.texts[a], 1), self.edge(self.texts[b], 0)
            i = j = 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.ranks.get((x, y), NEVER)
                if across < x_ends and across <= y_ends and across < NEVER:
                    known = False
                    break
                if x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.right[a][b] = known
            self.tried += 1
        return known


def sufficient_lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """Symbols of the longest token that the merges make: no token that ends later begins before the last so many places.

    A merge's token has as many symbols as its two parts; what no merge makes is one symbol.
    """
    size: dict[str, int] = {}
    for a, b in merges:
        size[a + b] = size.get(a, 1) + size.get(b, 1)
    return max(size.values(), default=1) + (1 if end else 0)


class Encoder:
    """Takes a word in blocks of characters and returns the ids of tokens that are settled."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.found = [-1]  # last token of the encoding up to each place that is still kept; -1 at the word's start
        self.began = [0]  # where that token began

    def feed(self, block: str) -> list[int]:
        """block: printable characters of bytes; the one that ends a word is followed by END."""
        found, began, beside = self.found, self.began, self.v.beside
        base = len(found)
        found += [None] * len(block)
        began += [0] * len(block)
        # The kept places' characters are matched once more, so that tokens across the border are seen.
        kept = self.text[1 - base :] if base > 1 else ""
        for end, (length, token) in self.v.matches.iter(kept + block):  # at each end the longest first
            end += 1
            if found[end] is not None:
                continue
            k = end - length
            before = found[k] if k >= 0 else None
            if before is None:
                continue
            if before < 0 or beside(before, token):
                found[end] = token
                began[end] = k
        self.text = kept + block
        return self._settle() if len(found) > BLOCK else []

    text = ""

    def _chain(self, place: int) -> list[int]:
        out = []
        while place:
            out.append(self.found[place])
            place = self.began[place]
        return out[::-1]

    def _settle(self) -> list[int]:
        """Emit what the chains of all places that a later token can begin at have in common."""
        n = len(self.found) - 1
        live = {k for k in range(max(0, n - self.v.lookahead), n + 1) if self.found[k] is not None}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(self.began[far])
        place = live.pop()
        if not place:
            return []
        out = self._chain(place)
        # The token before the cut stays known for its next neighbour.
        self.text = self.text[place:]
        self.found = self.found[place:]
        self.began = [0] + [k - place for k in self.began[place + 1 :]]
        for k, b in enumerate(self.began):
            if b < 0:  # a place that no later token can reach
                self.found[k], self.began[k] = None, 0
        return out

    def finish(self) -> list[int]:
        if self.found[-1] is None:
            raise ValueError("the vocabulary lacks a symbol")
        return self._chain(len(self.found) - 1)


def written_form(part: str, v: Vocabulary) -> str:
    """The printable characters of a part's bytes."""
    if part.isascii() and part.isprintable():
        return part
    return part.encode("utf-8", "surrogatepass").decode("latin-1").translate(v.byte)


def encode_short(word: str, v: Vocabulary) -> list[int]:
    """The tokens of a word that is read at once: the encoder's steps, with nothing to settle before the end.

    Of a place is kept what was tried at the right of its token, so that a token that ends later is looked up by itself.
    """
    written = written_form(word, v) + v.mark
    n = len(written)
    found, began, right = [-1] * (n + 1), [0] * (n + 1), [None] * (n + 1)
    right[0] = {}
    every, beside = v.right, v.beside
    for last, (length, token) in v.matches.iter(written):  # at each end the longest first
        end = last + 1
        if right[end] is not None:
            continue
        k = end - length
        tried = right[k]
        if tried is None:
            continue
        if k:
            ok = tried.get(token)
            if ok is None:
                ok = beside(found[k], token)
            if not ok:
                continue
        found[end], began[end], right[end] = token, k, every[token]
    if right[n] is None:
        raise ValueError("the vocabulary lacks a symbol")
    out = []
    while n:
        out.append(found[n])
        n = began[n]
    out.reverse()
    return out


def encode_word(word: str, v: Vocabulary) -> Iterator[list[int]]:
    """The tokens of one word, which the splitter made, as they are settled."""
    encoder = Encoder(v)
    for at in range(0, len(word), BLOCK):
        part = word[at : at + BLOCK]
        written = written_form(part, v)
        if ids := encoder.feed(written + v.mark if at + BLOCK >= len(word) else written):
            yield ids
    yield encoder.finish()


def chunks(text: str) -> list[str]:
    """A normalised text, split at its white space, where no word goes on."""
    if not text.isascii():
        # Character by character: a capital sigma doesn't look at its place in a word.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    # Python's white space has four control characters more.
    return [c for c in SPACE.split(text) if c] if CONTROL.search(text) else text.split()


def segments(text: str, a: int, b: int) -> Iterator[str]:
    """text[a:b] in parts of about SEGMENT characters, cut at white space: each is normalised and split by itself."""
    while a < b:
        cut = b
        if b - a > SEGMENT and (m := SPACE.search(text, a + SEGMENT, b)):
            cut = m.end()
        yield text[a:cut]
        a = cut


class Codec:
    """Encodes whole texts, a bounded number of tokens at a time; remembers bounded numbers of short chunks and words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known = Memory(self._chunk, CACHE_CHUNKS)
        self.words = Memory(self._word, CACHE_WORDS)

    def _word(self, word: str) -> list[int]:
        return encode_short(word, self.v)

    def _chunk(self, chunk: str) -> list[int]:
        """The tokens of a chunk's words."""
        parts = [self.words[w] for w in self.v.words.findall(chunk)]
        return parts[0] if len(parts) == 1 else [i for p in parts for i in p]

    def _long(self, chunk: str) -> Iterator[list[int]]:
        for m in self.v.words.finditer(chunk):
            if m.end() - m.start() <= REMEMBERED:
                yield self.words[m[0]]
            else:
                yield from encode_word(m[0], self.v)

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a whole text, in lists of bounded size."""
        text, v, known = text or "", self.v, self.known
        at = 0
        marks = v.special.finditer(text) if v.special else ()
        for a, b, mark in chain(((m.start(), m.end(), m[0]) for m in marks), [(len(text), len(text), None)]):
            for part in segments(text, at, a):
                found: list[int] = []
                for c in chunks(part):
                    if len(c) <= REMEMBERED:
                        found += known[c]
                    else:
                        yield found
                        found = []
                        yield from self._long(c)
                yield found
            if mark is not None:
                yield [v.added[mark]]
            at = b


class Decoder:
    """Incremental state machine from token ids to text.

    Its state is what an incomplete character has had of bytes; word ends become spaces. With `forms` it gives what the
    library's decode does for a file without decoder: the tokens' written forms, with a space before each but the first,
    so that the state is whether there was one.
    """

    def __init__(self, v: Vocabulary, forms: bool = False):
        self.v, self.forms, self.started = v, forms, False
        self.byte = {c: b for b, c in v.byte.items()}  # of printable characters
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        written = self.v.texts[token]
        if written in self.v.added:
            return self.utf8.decode(b"", final=True) + written
        ends = bool(self.v.end) and written.endswith(self.v.end)
        stem = written[: -len(self.v.end)] if ends else written
        return self.utf8.decode(bytes(self.byte[c] for c in stem)) + (" " if ends else "")

    def feed(self, ids: list[int]) -> str:
        """The text that some more ids add."""
        if not self.forms:
            return "".join(map(self.push, ids))
        if not ids:
            return ""
        out = " ".join(map(self.v.texts.__getitem__, ids))
        out, self.started = (" " + out if self.started else out), True
        return out

    def finish(self) -> str:
        return self.utf8.decode(b"", final=True)


@cache
def codec(path: str) -> Codec:
    """One for each worker process, which tasks share."""
    return Codec(Vocabulary(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens and the token ids of each text."""

    def make():
        c = codec(path)

        def run(texts):
            rows = [[i for ids in c.encode(t) for i in ids] for t in texts]
            return [list(map(len, rows)), rows]

        return run

    return per_text(docs, [id_col], text_col, "n_tokens bigint, ids array<int>", make)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col and the text of each row's ids (column ids), through the decoding state machine."""
    from pyspark.sql import functions as F

    def make():
        v = codec(path).v

        def text(ids):
            d = Decoder(v)
            return d.feed(list(map(int, (ids or "").split()))) + d.finish()

        return lambda rows: [[text(r) for r in rows]]

    flat = encoded.select(id_col, F.concat_ws(" ", F.col("ids").cast("array<string>")).alias("ids"))
    return per_text(flat, [id_col], "ids", "text string", make)


def digest(c: Codec, text: str | None) -> tuple[int, str, str]:
    """Number of tokens, and SHA-256 of the ids and of what they decode to; neither is ever held whole."""
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
    decoder, name = Decoder(c.v, forms=True), c.v.names.__getitem__
    for ids in c.encode(text):
        if ids:
            ids_hash.update(((" " if n else "") + " ".join(map(name, ids))).encode())
            text_hash.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
            n += len(ids)
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: number of tokens, and SHA-256 of the ids (decimal, space-joined) and of the text decoded from them."""

    def make():
        c = codec(path)
        return lambda texts: list(zip(*(digest(c, t) for t in texts), strict=True)) or [[], [], []]

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return per_text(docs, [id_col], text_col, schema, make)
