"""Secret scanning: fixed patterns, and a linear-chain conditional random field that adds to them.

Base patterns (assign, access, hex) are found as regular expressions say. The field tags every token
of every text B (a secret begins), I (inside) or O. Tokens are runs of letters, digits, ``_+/-``, or
single marks; chunks are what white space parts, and no secret goes on beyond its chunk: the first
token of one is never I. Emissions see the token's shape (length, classes of
characters, their changes and variety, beginnings), its place in its chunk and the chunk's shape, the
neighbouring words (three before, one after, and how far the nearest lead word such as password or
token is, together with the shapes) and the file (share of digits, of assignments, length).

All features of a token or chunk alone, and what it says to its neighbours, are looked up by its
kind, so emissions of a slice of texts are sums of a few gathered tables, linear in the text. Viterbi
is exact: a token is surely O where turning any other tag of it to O (and a following I to B) gains
whatever its neighbours are; these part a text into runs, decoded one by one.

Training (bounded): of the texts that hold something like a base match, and of all texts, the first
by hash as far as ``FIT_ROWS`` and ``FIT_CHARS`` characters go, whole, tagged by the base patterns, plus ``MADE`` seeded
sentences with invented secrets, of common formats, of letters alone, short ones and ones broken by
symbols, and with look-alikes that aren't secrets. The likelihood is that of windows of ``WINDOW``
tokens given the tags beside them; its gradient comes from forward-backward over all windows at once
(numpy, Adam, seeded).

Spans are kind:start:end in code points, end exclusive, by start, then kind (assign, access, hex,
crf). The field's spans are listed by their own extents: where a base span takes in the key's name,
the field's is the value.

Edge cases. Null or empty text: no spans, the digest of nothing. Null doc_id: kept as null, not
trained on. Very long texts, of one chunk too: scanned whole, in linear time. Repeated rows: alike,
trained on once. Rows of one id and different texts: each its own spans; the least is trained on.
Equal starts: by kind. Equal scores of two taggings: the one with more O. Empty table: no rows, and
the field is trained on the invented sentences alone. Columns other than doc_id and text are not read,
whatever their names; ``redact`` returns them untouched, but for n_chars, which it counts anew.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_arrow, place, remembered

FIT_ROWS, FIT_CHARS, MADE, WINDOW = 200, 400_000, 1500, 32
#: Chunks that a worker remembers before it begins anew; characters that are tagged together (a longer text alone).
REMEMBER, SLICE = 200_000, 500_000

# The base patterns, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")

_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # HEX's maximal runs that are long enough
_HEX_DIGITS = "0123456789abcdef"
#: Bytes as 1 where they are hex digits, else 0; and as many of the former as a hex span has at least.
_IS_HEX, _LONG_HEX = bytes(chr(b) in _HEX_DIGITS for b in range(256)), b"\1" * HEX_LEAST
#: Where none of these is, in small letters, ASSIGN finds nothing.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_MIXED = re.compile(r"[a-z][A-Z]")
#: Words near which secrets stand; a feature of the chunks around.
_LEAD = re.compile(r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|(?<![a-z])(?:api|access|auth|private|secret)?[_ -]?key)s?(?![a-z])", re.IGNORECASE | re.ASCII)
_LEADS = re.compile("pass|pwd|secret|token|credential|bearer|key")
#: Chunks behind and ahead of a lead word that see it.
AFTER, BEFORE = 6, 3
_CHUNK = re.compile(r"\S+")
_TOKEN = re.compile(r"[\w+/-]{16,}={1,2}(?![\w=])|[\w+/-]+|[^\w\s]")
TAGS = "OBI"
NEVER = -1e9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _LONG_HEX in text.encode("utf-8", "replace").translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def shown(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class _Class(dict):
    """Character -> d (digit), u (capital), l (other letter) or s (other), as a table of str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = found = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s"
        return found


_CLASS = _Class()
_CHANGE = re.compile(r"(?<=d)[^d]|(?<=u)[^u]|(?<=l)[^l]|(?<=s)[^s]")
_SETS = {"".join(k for k, bit in zip("dlsu", bits, strict=True) if bit): n for n, bits in enumerate(np.ndindex(2, 2, 2, 2))}
_SMALL, _CAPITAL, _LETTERS, _HEXES = _SETS["l"], _SETS["lu"], {_SETS[k] for k in ("l", "u", "lu")}, {_SETS[k] for k in ("d", "l", "dl")}
LENGTHS, CHANGES, KINDS_OF, DIGITS, HEXES, HARSH = (2, 4, 6, 8, 12, 16, 20, 24, 32, 48), (0.05, 0.15, 0.3, 0.45), (4, 6, 8, 10, 13, 16, 20), (0.01, 0.1, 0.3, 0.5, 0.8, 1), (8, 16, 24, 32), (4, 5, 6, 8)
N_LENGTHS = len(LENGTHS) + 1
N_SHAPES = len(_SETS) * N_LENGTHS * 2
#: Sizes of what a token shows by itself: shape, hex digits only (by length), changes of class, different characters, digits, runs of consonants.
OWN = (N_SHAPES, len(HEXES) + 2, len(_SETS) * (len(CHANGES) + 1), N_LENGTHS * (len(KINDS_OF) + 1), len(DIGITS) + 1, len(HARSH) + 1)
_CONSONANTS = re.compile("[^aeiouyAEIOUY]{4,}")


def shape_of(text: str) -> int:
    """Classes of characters, length and whether capitals follow small letters, as one number."""
    length = bisect_right(LENGTHS, len(text))
    if text.islower() and text.isalpha():
        return (_SMALL * N_LENGTHS + length) * 2
    classes = text.translate(_CLASS)
    return (_SETS["".join(sorted(set(classes)))] * N_LENGTHS + length) * 2 + ("lu" in classes)


def own_codes(t: str) -> tuple[int, ...]:
    """A number below each of OWN."""
    n = len(t)
    length, changes, digits = bisect_right(LENGTHS, n), 0, 0
    if t.islower() and t.isalpha():
        kinds, mixed = _SMALL, 0
    elif t[0].isupper() and (rest := t[1:]).islower() and rest.isalpha():
        kinds, mixed, changes = _CAPITAL, 0, bisect_right(CHANGES, 1 / (n - 1))
    else:
        classes = t.translate(_CLASS)
        some = sorted(set(classes))
        kinds, mixed = _SETS["".join(some)], "lu" in classes
        if len(some) > 1:
            changes = bisect_right(CHANGES, len(_CHANGE.findall(classes)) / (n - 1))
        digits = bisect_right(DIGITS, classes.count("d") / n)
    harsh = bisect_right(HARSH, max(map(len, found))) if n > 3 and kinds in _LETTERS and (found := _CONSONANTS.findall(t)) else 0
    hexes = 1 + bisect_right(HEXES, n) if kinds in _HEXES and not t.strip(_HEX_DIGITS) else 0
    return (kinds * N_LENGTHS + length) * 2 + mixed, hexes, kinds * (len(CHANGES) + 1) + changes, length * (len(KINDS_OF) + 1) + bisect_right(KINDS_OF, len(set(t))), digits, harsh


def word_of(token: str) -> str:
    n = len(token)
    return token.lower() if n == 1 or n <= 14 and token.isalpha() else f"#{''.join(sorted(set(token.translate(_CLASS))))}{n > 7}"


def start_of(token: str) -> str:
    return token[:3].lower() if not token[0].isdigit() else "0"


FILE = (5, 4, 7)


def file_codes(text: str) -> tuple[int, int, int]:
    """The file's share of digits and of assignments, and its length, each below its number of FILE."""
    n = max(1, len(text))
    digits = sum(map(text.count, string.digits)) / n
    return min(4, int(digits * 40)), min(3, text.count("=") * 200 // n), min(6, int(math.log10(n)))


#: Places of a token whose words it sees (before it; behind, where negative).
NEIGHBOURS = (1, 2, 3, -1)
N_LEADS, N_PLACES = 2 + AFTER + BEFORE, 4
EDGE = 3  # tokens between two texts


class Memory(dict):
    """chunk -> number; tokens of chunks, shapes, and the codes of each kind of token.

    A kind's codes are those of OWN, of its start and of its word; words and starts that aren't in the
    vocabularies are 0, the edge's word is 1.
    """

    def __init__(self, words: dict[str, int], starts: dict[str, int]):
        super().__init__()
        self.words, self.starts, self.kinds, self.shapes = words, starts, {}, [0]
        edge = 0
        self.codes = array("i", (*[0] * len(OWN), 0, 1))
        self.flat, self.chunks = array("i", [edge] * EDGE), array("i", (0, EDGE, 0, 0))  # first token, tokens, shape, whether it has a lead word
        self.weighed: np.ndarray | None = None

    def __missing__(self, chunk: str) -> int:
        kinds, flat = self.kinds, self.flat
        tokens, first = _TOKEN.findall(chunk), len(flat)
        for t in tokens:
            kind = kinds.get(t)
            if kind is None:
                own = own_codes(t)
                kinds[t] = kind = len(self.shapes)
                self.codes.extend((*own, self.starts.get(start_of(t), 0), self.words.get(word_of(t), 0)))
                self.shapes.append(own[0])
            flat.append(kind)
        # Most chunks are a word and marks behind it.
        bare = chunk.strip("\"'`.,;:()[]<>") or chunk[:1]
        shape = self.shapes[kinds[bare]] if bare in kinds else shape_of(bare)
        lead = _LEADS.search(chunk.lower()) is not None and _LEAD.search(chunk) is not None
        self[chunk] = found = len(self.chunks) // 4
        self.chunks.extend((first, len(tokens), shape, lead))
        return found

    def codes_of(self, first: int = 0) -> np.ndarray:
        """The codes of each kind of token, from the first asked for on."""
        width = len(OWN) + 2
        return np.frombuffer(self.codes, np.int32)[first * width :].reshape(-1, width).copy()


class Tokens:
    """The tokens of some texts side by side, EDGE empty ones after each: kind, shape, chunk and what the chunk says."""

    def __init__(self, texts: list[str], memory: Memory):
        split = [t.split() for t in texts]
        sizes = np.asarray([len(c) + 1 for c in split])
        self.ends = np.cumsum(sizes)  # chunks of each text, with the edge
        numbers = np.fromiter(chain.from_iterable(chain(map(memory.__getitem__, c), (0,)) for c in split), np.int64, int(self.ends[-1]) if texts else 0)
        chunks, flat = np.array(memory.chunks, np.int64).reshape(-1, 4)[numbers], np.array(memory.flat, np.int64)
        self.first_chunk = self.ends - sizes
        counts = chunks[:, 1]
        self.starts = np.cumsum(counts) - counts  # first token of each chunk
        n = int(counts.sum())
        self.chunk = np.repeat(np.arange(len(numbers)), counts)
        at = np.arange(n) - self.starts[self.chunk]  # place in the chunk
        self.kind = flat[chunks[self.chunk, 0] + at]
        self.real = numbers[self.chunk] > 0
        self.shape = np.array(memory.shapes, np.int64)[self.kind]
        self.place = (at > 0) + 2 * (at + 1 < counts[self.chunk])
        self.text = np.repeat(np.arange(len(texts)), sizes)
        lead, self.chunk_shape = self._leads(chunks[:, 3] > 0), chunks[:, 2]
        self.lead, self.chunk_shape = lead[self.chunk], self.chunk_shape[self.chunk]
        self.text = self.text[self.chunk]

    def _leads(self, lead: np.ndarray) -> np.ndarray:
        """0: no lead word near; 1: in the chunk; 2..: so many chunks after one; then: so many before one. What follows is nearer."""
        at, begin = np.arange(len(lead)), self.first_chunk[self.text]
        last = np.maximum.accumulate(np.where(lead, at, -1)) if len(at) else at
        following = np.minimum.accumulate(np.where(lead, at, len(lead) + AFTER)[::-1])[::-1] if len(at) else at
        after, before = np.where(last >= begin, at - last, AFTER + 1), np.where(following < self.ends[self.text], following - at, BEFORE + 1)
        return np.where((after <= AFTER) & (after <= before), 1 + after, np.where(before <= BEFORE, 1 + AFTER + before, 0))

    def shifted(self, kinds: np.ndarray, by: int) -> np.ndarray:
        """The kind of the token so many places before (behind, where negative)."""
        out = np.zeros_like(kinds)
        if by > 0:
            out[by:] = kinds[:-by]
        else:
            out[:by] = kinds[-by:]
        return out


#: Pairs: lead and chunk's shape, lead and token's shape, place and token's shape.
GRIDS = (N_LEADS * N_SHAPES, N_LEADS * N_SHAPES, N_PLACES * N_SHAPES)


def grid_cells(x: Tokens) -> list[np.ndarray]:
    return [x.lead * N_SHAPES + x.chunk_shape, x.lead * N_SHAPES + x.shape, x.place * N_SHAPES + x.shape]


def decode(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Viterbi over one row of tokens with O before and after it; e: n x 3, move: tag by tag."""
    n = len(e)
    tags = np.zeros(n, np.int8)
    if not n:
        return tags
    # What the best tagging could lose at most by turning a tag y to O and a following I to B.
    gain = max(
        move[p, y] + move[y, k] + move[k, q] - move[p, 0] - move[0, 1 if k == 2 else k] - move[1 if k == 2 else k, q]
        for p in range(3) for y in (1, 2) for k in range(3) for q in range(3)
        if move[p, y] > NEVER / 2 and move[y, k] > NEVER / 2 and move[k, q] > NEVER / 2
    )
    drop = np.maximum(0, np.append(e[1:, 2] - e[1:, 1], 0))
    open_ = np.flatnonzero(np.maximum(e[:, 1], e[:, 2]) - e[:, 0] + drop + gain >= 0)
    if not len(open_):
        return tags
    cuts = np.flatnonzero(np.diff(open_) > 1) + 1
    firsts, lasts = open_[np.r_[0, cuts]], open_[np.r_[cuts - 1, len(open_) - 1]]
    single = firsts == lasts
    alone = firsts[single]
    tags[alone[e[alone, 1] + move[0, 1] + move[1, 0] > e[alone, 0] + 2 * move[0, 0]]] = 1
    m = move.tolist()
    for a, b in zip(firsts[~single].tolist(), lasts[~single].tolist(), strict=True):
        rows = e[a : b + 1].tolist()
        score = [rows[0][k] + m[0][k] for k in range(3)]
        back = []
        for row in rows[1:]:
            came = [max(range(3), key=lambda j, k=k: score[j] + m[j][k]) for k in range(3)]
            score = [score[came[k]] + m[came[k]][k] + row[k] for k in range(3)]
            back.append(came)
        tag = max(range(3), key=lambda j: score[j] + m[j][0])
        for i in range(b, a - 1, -1):
            tags[i] = tag
            tag = back[i - a - 1][tag] if i > a else tag
    return tags


class Field:
    """The trained field: the vocabularies, a table of weights by tag for each feature, and transitions.

    Tables are those of OWN, starts, own words, words of each of NEIGHBOURS, GRIDS and FILE, in this order.
    """

    def __init__(self, words: dict[str, int], starts: dict[str, int], tables: list[np.ndarray], transitions: np.ndarray):
        self.words, self.starts, self.tables, self.transitions = words, starts, tables, transitions
        self.name = hashlib.sha256(repr((sorted(words.items()), sorted(starts.items()))).encode() + b"".join(t.tobytes() for t in tables) + transitions.tobytes()).hexdigest()

    @staticmethod
    def sizes(words: dict[str, int], starts: dict[str, int]) -> list[int]:
        return [*OWN, len(starts) + 1, *[len(words) + 2] * (1 + len(NEIGHBOURS)), *GRIDS, *FILE]

    def memory(self) -> Memory:
        return Memory(self.words, self.starts)

    def _weighed(self, memory: Memory) -> np.ndarray:
        """What each kind of token adds to its own emissions, and to those of each neighbour."""
        done, own = 0 if memory.weighed is None else len(memory.weighed), len(OWN) + 2
        new = memory.codes_of(done)
        if len(new):
            alone = sum(t[new[:, i]] for i, t in enumerate(self.tables[:own]))
            parts = np.concatenate([alone, *[t[new[:, -1]] for t in self.tables[own : own + len(NEIGHBOURS)]]], axis=1)
            memory.weighed = parts if memory.weighed is None else np.concatenate([memory.weighed, parts])
        return memory.weighed

    def emissions(self, texts: list[str], x: Tokens, memory: Memory) -> np.ndarray:
        weighed = self._weighed(memory)
        out = weighed[x.kind, :3].astype(np.float64)
        for i, by in enumerate(NEIGHBOURS, 1):
            out += weighed[x.shifted(x.kind, by), 3 * i : 3 * i + 3]
        for table, cells in zip(self.tables[-6:-3], grid_cells(x), strict=True):
            out += table[cells]
        files = np.asarray([file_codes(t) for t in texts]).reshape(-1, 3)
        out += sum(t[files[:, i]] for i, t in enumerate(self.tables[-3:]))[x.text]
        out[x.place & 1 == 0, 2] = NEVER  # the first of a chunk
        out[~x.real] = 0, NEVER, NEVER
        return out

    def spans_of(self, texts: list[str], memory: Memory) -> list[list[tuple[int, int]]]:
        """Places of secrets in each text."""
        if len(memory) > REMEMBER:
            memory.clear()
            memory.__init__(memory.words, memory.starts)
        x = Tokens(texts, memory)
        tags = decode(self.emissions(texts, x, memory), self.transitions)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(tags == 1).tolist():
            last = i
            while last + 1 < len(tags) and tags[last + 1] == 2:
                last += 1
            found.setdefault(int(x.text[i]), []).append((i, last))
        for n, runs in found.items():
            chunks = [m.span() for m in _CHUNK.finditer(texts[n])]
            known: dict[int, list[tuple[int, int]]] = {}

            def where(i: int) -> tuple[int, int]:
                c = int(x.chunk[i])
                a, b = chunks[c - x.first_chunk[n]]  # noqa: B023
                if c not in known:  # noqa: B023
                    known[c] = [(a + t.start(), a + t.end()) for t in _TOKEN.finditer(texts[n][a:b])]  # noqa: B023
                return known[c][i - int(x.starts[c])]  # noqa: B023

            out[n] = [(where(a)[0], where(b)[1]) for a, b in runs]
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.spans_of([text], self.memory())[0]


def value_spans(text: str) -> list[tuple[int, int]]:
    """What the base patterns find, without the key's name."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            out.append((m.start(2), m.end(2)))
    for a, k, b in base_spans(text):
        if k and not any(x <= a and b <= y for x, y in out):
            out.append((a, b))
    return out


def invented(count: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Sentences with invented secrets and look-alikes, and where the secrets are."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    letters, digits = string.ascii_letters, string.digits
    plain = ["the", "value", "was", "set", "in", "config", "we", "use", "for", "with", "la", "de", "und", "que", "file", "and", "then", "returns", "line"]
    usual = "is are was not been has will can should must may it this that your our my their server user account required reset expired invalid missing stored changed field table value name number sequence model training count length vocabulary special required before after during first last next each every important question issue point idea finding paper result method encoder attention expression authentication documentation characteristics and or from into about between without".split()
    names = "hunter dragon monkey shadow summer winter welcome password secret letme admin qwerty sunshine princess football baseball master orange banana rocket tiger".split()
    camel = ["JavaScript", "getElementById", "PowerPoint", "MacDonald", "toString", "isEmptyList", "userAccountName", "PostgreSQL", "LaTeXdocument", "YouTubeChannel", "OpenStreetMap", "maxTokenCount", "WordPress", "hasNextElement", "DataFrame"]
    leet = lambda w: "".join({"a": "@", "o": "0", "e": "3", "i": "1", "s": "$"}.get(c, c) if rng.random() < 0.6 else c for c in w.capitalize())
    secret = [
        lambda: "ghp_" + pick(letters + digits, 36), lambda: "sk_live_" + pick(letters + digits, 24), lambda: "xoxb-" + pick(digits, 11) + "-" + pick(letters + digits, 24),
        lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])), lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16), lambda: pick(letters + digits + "+/", 40) + "=",
        lambda: "eyJ" + pick(letters + digits, 20) + "." + pick(letters + digits, 30) + "." + pick(letters + digits + "_-", 40), lambda: "AIza" + pick(letters + digits + "_-", 35), lambda: pick(letters + digits, rng.randint(10, 48)),
        lambda: pick(letters, rng.randint(10, 40)), lambda: pick(string.ascii_lowercase, rng.randint(14, 32)), lambda: rng.choice(names) + pick(digits, rng.randint(1, 4)), lambda: leet(rng.choice(names)) + rng.choice(["!", "!!", "#1", "$", "?", "@9", "*"]),
        lambda: rng.choice(usual + names) + pick(digits, rng.randint(1, 4)), lambda: pick(string.ascii_lowercase, rng.randint(3, 7)) + pick(digits, rng.randint(1, 4)), lambda: pick(string.ascii_lowercase + digits, rng.randint(5, 9)) + pick(digits, 1),
        lambda: pick(letters + digits + "!@#$%^&*", rng.randint(6, 16)) + rng.choice("!@#$%^&*") + pick(letters + digits, rng.randint(1, 6)),
    ]
    lead = ["password is", "token", "secret", "api key", "Authorization: Bearer", "client_secret =", "key:", "credentials", "export TOKEN=", "passwd:", "access key", "pwd", "password:", "the password for the server is", "bearer", "secret key is", "passphrase", "token is", "credentials:", "API key:"]
    other = [
        lambda: pick(digits, rng.choice([8, 10, 13, 16])), lambda: f"20{pick(digits, 2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}",
        lambda: f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", lambda: f"user.{pick(digits, 2)}@mail{rng.randint(1, 9)}.example.com", lambda: f"https://example.com/page/{pick(digits, 5)}/index.html",
        lambda: f"release-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: rng.choice(plain) + rng.choice(plain) + pick(digits, 2), lambda: f"section{pick(digits, 2)}title", lambda: f"{pick(digits, 3)}.{pick(digits, 3)}.{pick(digits, 2)}.{pick(digits, 3)}", lambda: f"ORDER-{pick(digits, 8)}", lambda: f"isbn97{pick(digits, 11)}",
        # Long words, of syllables as they are spoken.
        lambda: "".join(pick("bcdfghklmnprstvwz", 1) + rng.choice(["a", "e", "i", "o", "u", "en", "er", "un", "ati", "eit", "ou", "ing", "ion"]) for _ in range(rng.randint(3, 10))),
        lambda: rng.choice(usual) + rng.choice(usual) + rng.choice(["", rng.choice(usual)]), lambda: rng.choice(usual).upper() + rng.choice(["", "!", ",", "!!"]),
    ]
    strong = secret[:7]  # formats that show by themselves
    out = []
    for _ in range(count):
        words, at, spans = [], 0, []
        for _ in range(rng.randint(4, 12)):
            kind = rng.random()
            if kind < 0.15:
                w = rng.choice(lead) + " "
                at_word, value = at + len(w), rng.choice(secret)()
                quote = rng.choice(["", '"', "'"])
                spans.append((at_word + len(quote), at_word + len(quote) + len(value)))
                w += quote + value + quote
            elif kind < 0.17:
                w = rng.choice(strong)()
                spans.append((at, at + len(w)))
            elif kind < 0.24:
                w = rng.choice(["password", "token", "secret", "key", "credentials", "bearer", "tokens", "the key", "passwords"]) + " " + " ".join(rng.choice(usual) for _ in range(rng.randint(1, 5)))
            elif kind < 0.30:
                w = rng.choice([rng.choice(camel), rng.choice(usual).capitalize(), rng.choice(usual) + rng.choice(".,;:"), str(rng.randint(1, 999))])
            elif kind < 0.50:
                w = rng.choice(other)() + rng.choice(["", ".", ",", "###"])
            else:
                w = rng.choice(rng.choice([plain, usual]))
            words.append(w)
            at += len(w) + 1
        out.append((" ".join(words), spans))
    return out


def tags_of(texts: list[str], spans: list[list[tuple[int, int]]], x: Tokens) -> np.ndarray:
    """Tags of the tokens by known spans of secret values; a token counts that lies in a span whole."""
    out = np.zeros(len(x.kind), np.int64)
    for n, text in enumerate(texts):
        if not spans[n]:
            continue
        at = int(x.starts[x.first_chunk[n]])
        places = [(a + t.start(), a + t.end()) for a, b in (m.span() for m in _CHUNK.finditer(text)) for t in _TOKEN.finditer(text[a:b])]
        begins = np.asarray([a for a, _ in places])
        for a, b in spans[n]:
            tag = 1
            for i in range(int(np.searchsorted(begins, a)), len(places)):
                if places[i][1] > b:
                    break
                out[at + i] = tag
                tag = 2
    return out


def train(tagged: list[tuple[str, list[tuple[int, int]]]], steps: int = 80) -> Field:
    """Maximum likelihood with a small penalty, over windows of all tokens at once."""
    texts, spans = [t for t, _ in tagged], [s for _, s in tagged]
    tokens = Counter(t for text in texts for chunk in text.split() for t in _TOKEN.findall(chunk))

    def often(of) -> list[str]:
        counts: Counter[str] = Counter()
        for t, n in tokens.items():
            counts[of(t)] += n
        return sorted(k for k, n in counts.items() if n > 2)

    words = {w: i for i, w in enumerate(often(word_of), 2)}
    starts = {w: i for i, w in enumerate(often(start_of), 1)}
    memory = Memory(words, starts)
    x = Tokens(texts, memory)
    codes = memory.codes_of().astype(np.int64)
    files = np.asarray([file_codes(t) for t in texts], np.int64).reshape(-1, 3)
    columns = [*codes[x.kind].T, *[codes[x.shifted(x.kind, by), -1] for by in NEIGHBOURS], *grid_cells(x), *files[x.text].T]
    sizes = Field.sizes(words, starts)
    firsts = np.cumsum([1, *sizes])  # 0 is no feature
    features = np.stack([c + f for c, f in zip(columns, firsts, strict=False)], axis=1)
    features[~x.real] = 0
    size = int(firsts[-1])
    # Features seen less than three times tell nothing.
    features[np.bincount(features.ravel(), minlength=size)[features] < 3] = 0

    gold_all = tags_of(texts, spans, x)
    n = len(gold_all)
    windows = -(-n // WINDOW)
    full = windows * WINDOW
    pad = lambda a: np.concatenate([a, np.zeros((full - n, *a.shape[1:]), a.dtype)])
    features, gold = pad(features), pad(gold_all).reshape(windows, WINDOW)
    real = pad(x.real).reshape(windows, WINDOW)
    first = pad(x.place & 1 == 0).reshape(windows, WINDOW)
    before, behind = np.r_[0, gold[:-1, -1]], np.r_[gold[1:, 0], 0]
    weights, move = np.zeros((size, 3)), np.zeros((3, 3))
    move[0, 2] = NEVER  # I only follows B or I
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]
    hot = np.eye(3)[gold]
    seen = np.einsum("ntj,ntk->jk", hot[:, :-1], hot[:, 1:]) + np.einsum("nj,nk->jk", np.eye(3)[before], hot[:, 0]) + np.einsum("nj,nk->jk", hot[:, -1], np.eye(3)[behind])
    seen -= np.einsum("nj,nk->jk", hot[:-1, -1], hot[1:, 0])  # a window's last pair is the next one's first
    for step in range(1, steps + 1 if n else 0):
        e = np.stack([np.take(weights[:, k], features).sum(axis=1) for k in range(3)], axis=1).reshape(windows, WINDOW, 3)
        e[first, 2] = NEVER
        e[~real] = 0, NEVER, NEVER
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + move[before]
        for t in range(1, WINDOW):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1) + e[:, t]
        backward[:, -1] = move[:, behind].T
        for t in range(WINDOW - 2, -1, -1):
            backward[:, t] = np.logaddexp.reduce(move[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[:, -1] + move[:, behind].T, axis=1)[:, None, None]
        here = np.exp(np.clip(forward + backward - total, -700, 0))
        error = ((here - hot) * real[..., None]).reshape(-1, 3)
        flat = features.ravel()
        grad = np.stack([np.bincount(flat, np.repeat(error[:, k], features.shape[1]), size) for k in range(3)], axis=1) / windows + 1e-4 * weights
        grad[0] = 0
        pairs = np.exp(np.clip(forward[:, :-1, :, None] + move + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[..., None], -700, 0)).sum(axis=(0, 1))
        ends = np.einsum("nj,nk->jk", np.eye(3)[before], here[:, 0]) + np.einsum("nj,nk->jk", here[:, -1], np.eye(3)[behind])
        ends -= np.einsum("nj,nk->jk", hot[:-1, -1], hot[1:, 0])
        shift = (pairs + ends - seen) / windows + 1e-4 * np.where(move < NEVER / 2, 0, move)
        shift[0, 2] = 0
        for p, g, a, b in ((weights, grad, 0, 1), (move, shift, 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * g
            state[b] = 0.99 * state[b] + 0.01 * g * g
            p -= 0.15 * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.99**step)) + 1e-8)
    weights = weights.astype(np.float32)
    return Field(words, starts, [weights[a:b] for a, b in zip(firsts, firsts[1:], strict=False)], move)


def fit(docs: DataFrame) -> Field:
    """A field trained on a bounded sample of docs, and on invented sentences."""
    usable = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & F.col("id").isNotNull())
    lower = F.lower("text")
    like = F.lit(False)
    for word in ("passw", "secret", "token", "api_key", "apikey"):
        like = like | lower.contains(word)
    like = like | F.col("text").contains("AKIA")
    sized = usable.select("id", F.xxhash64("id").alias("h"), F.length("text").alias("n"), like.alias("match"))
    chosen = []
    for part in (sized.filter("match"), sized):
        chars = 0
        for r in part.groupBy("h", "id").agg(F.max("n").alias("n")).orderBy("h", "id").limit(FIT_ROWS // 2).collect():
            if chars + r.n <= FIT_CHARS // 2:
                chosen.append((r.id,))
                chars += r.n
    texts = []
    if chosen:
        wanted = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(chosen)), "id long"))  # FIT_ROWS ids
        texts = [r.text for r in usable.join(wanted, "id").groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()]
    return train([(t, value_spans(t)) for t in texts] + invented(MADE))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, chars = [], 0
    for t in texts:
        if held and chars + len(t) > SLICE:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def spans_of_all(texts: list[str], field: Field, memory: Memory) -> list[list[tuple[int, int, int]]]:
    """Base spans and those of the field, in order, of each text."""
    out = []
    for some in _slices(texts):
        for t, found in zip(some, field.spans_of(some, memory), strict=True):
            out.append(sorted(base_spans(t) + [(a, 3, b) for a, b in found]))
    return out


def _finder(docs: DataFrame, field: Field | None):
    """A function of a column of texts that gives their spans, made once in each task."""
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))  # as many weights as features of a bounded sample

    def make():
        memory = remembered(f"secrets {shared.value.name}", shared.value.memory)  # of this field alone
        return lambda texts: spans_of_all([t or "" for t in texts], shared.value, memory)

    return make


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    finder = _finder(docs, field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            rows = []
            for spans in find(batch.column(1).to_pylist()):
                base = [s for s in spans if s[1] < 3]
                rows.append((*(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def without_spans(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redacted(text: str, field: Field) -> str:
    return without_spans(text, spans_of_all([text], field, field.memory())[0])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with secrets replaced in text (and n_chars, if there, counted anew); all other columns stay."""
    finder, at = _finder(docs, field), place(docs, "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [None if t is None else without_spans(t, spans) for t, spans in zip(texts, find(texts), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = map_arrow(docs, run, docs.schema)
    count = next((f for f in docs.schema.fields if f.name.lower() == "n_chars"), None)
    return out.withColumn(count.name, F.length("text").cast(count.dataType)) if count else out
