"""Personal data: fixed patterns, and spans that a character-level tagger adds."""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.char_tagger import BestTags, Tagger, encode

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_SEED = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The first run of digits is taken whole and from its start: a shorter part of it can match only if all of it does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 16 <= len(digits) <= 19 and _luhn(digits)


def _is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and then start, in code points.

    Each kind is matched from the left without overlap; matches that fail their check are dropped.
    """
    if not _SEED.search(text):
        return []
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", at + 1)
    out += [(1, *m.span()) for m in _IP.finditer(text) if _is_ip(m.group())]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _is_card(m.group())]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _tags(width: int, spans: list[Span]) -> np.ndarray:
    """0 outside; 1 + 2 * kind at a span's start, 2 + 2 * kind within."""
    out = np.zeros(width, np.int64)
    for kind, start, end in sorted(spans, reverse=True):
        out[start:end] = 2 + 2 * kind
        out[start : start + 1] = 1 + 2 * kind
    return out


def _bare_phones(text: str, spans: list[Span]) -> tuple[str, list[Span]] | None:
    """The text with the country codes of its phone numbers taken out, and its spans."""
    for _, start, end in sorted((s for s in spans if s[0] == 3), key=lambda s: -s[1]):
        m = re.match(r"\+[0-9]{1,3}[ .-]", text[start:end])
        if m and len(_digits(text[start + m.end() : end])) >= 7:
            n = m.end()
            text = text[:start] + text[start + n :]
            spans = [(k, a - n * (a > start), b - n * (b > start)) for k, a, b in spans]
    return (text, spans)


def train_tagger(docs: DataFrame, sample: int = 1000, width: int = 64, text: str = "text") -> Tagger | None:
    """Train on `sample` windows at most, one around the first digit or @ of a text, least hash first.

    The patterns give the labelled spans; windows with phone numbers come again without country codes,
    so that the tagger learns more than the patterns. None if no text has a digit or @.
    """
    at = F.regexp_instr(F.col(text), F.lit("[0-9@]"))
    window = F.substring(F.col(text), F.greatest(at - width // 2, F.lit(1)), F.lit(width))
    found = docs.where(F.col(text).rlike("[0-9@]")).select(window.alias("w"))
    texts = [r.w for r in found.orderBy(F.xxhash64("w"), "w").limit(sample).collect()]
    if not texts:
        return None
    rows = [(t, base_spans(t)) for t in texts]
    rows += [_bare_phones(t, spans) for t, spans in rows if any(s[0] == 3 for s in spans)]
    x = encode([t for t, _ in rows], width)
    y = np.stack([_tags(width, [(k, a, min(b, width)) for k, a, b in spans]) for _, spans in rows])
    return Tagger(1 + 2 * len(KINDS)).fit(x, y)


def _plausible(kind: int, text: str) -> bool:
    digits = len(_digits(text))
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", text) is not None
    if kind == 1:
        return _is_ip(text)
    if kind == 2:
        return _is_card(text)
    return 7 <= digits <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().+-]*[0-9]", text) is not None


#: Characters that an addition of each kind must not stand beside: it would be cut out of something longer.
_INSIDE = (re.compile(r"[\w@%+-]"), re.compile(r"[\w]"), re.compile(r"\w"), re.compile(r"\w"))
_MARKED = re.compile(r"[0-9][ .()-]$")


def _whole(kind: int, text: str, start: int, end: int) -> bool:
    """Whether nothing at either side of a span makes it a part of a longer number or address."""
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    if _INSIDE[kind].match(before[-1:]) or _INSIDE[kind].match(after[:1]):
        return False
    if kind == 0:
        return re.match(r"\.\w", after) is None and not before.endswith(".")
    return _MARKED.match(before) is None and _MARKED.match(after[::-1]) is None


class Finder:
    """The spans of many texts at a time: the patterns' and those that the tagger adds."""

    def __init__(self, tagger: Tagger | None, width: int = 64):
        self.tagger, self.width, self.hop = tagger, width, width // 2
        ramp = np.minimum(np.arange(width) + 1, np.arange(width)[::-1] + 1)
        self.weight = ramp.astype(np.float32)[:, None]  # a window's edge lacks context

    def find(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text."""
        base = [base_spans(t) for t in texts]
        added = self._tagged(texts) if self.tagger else [[] for _ in texts]
        out = []
        for t, own, more in zip(texts, base, added, strict=True):
            taken = sorted((a, b) for _, a, b in own)
            free = [(k, a, b) for k, a, b in more if all(b <= x or a >= y for x, y in taken) and _plausible(k, t[a:b]) and _whole(k, t, a, b)]
            out.append((own, sorted(own + free)))
        return out

    def _tagged(self, texts: list[str]) -> list[list[Span]]:
        """Spans by the tagger. Every kind needs a digit or @, so only windows with one are run.

        Windows overlap by half. Their scores are averaged, the edges weighing less, and each stretch of
        windows, however long, is decoded as a whole; so a span never depends on which window it fell into
        nor on how many windows are run at a time.
        """
        places = []
        for i, t in enumerate(texts):
            wanted = {k for m in _SEED.finditer(t) for k in (m.start() // self.hop - 1, m.start() // self.hop) if k >= 0}
            places += [(i, k) for k in sorted(wanted)]
        out: list[list[Span]] = [[] for _ in texts]
        path, before = None, None
        for low in range(0, len(places), 512):
            part = places[low : low + 512]
            x = encode([texts[i][k * self.hop : k * self.hop + self.width] for i, k in part], self.width)
            for (i, k), scores in zip(part, self.tagger.emissions(x), strict=True):
                if before != (i, k - 1):
                    if path:
                        out[before[0]] += path.spans()
                    path = _Stretch(self, texts[i], k * self.hop)
                path.add(scores)
                before = i, k
        if path:
            out[before[0]] += path.spans()
        return out


class _Stretch:
    """Neighbouring windows of a text: averages their scores and decodes them as they come."""

    def __init__(self, finder: Finder, text: str, offset: int):
        self.text, self.offset, self.hop, self.weight = text, offset, finder.hop, finder.weight
        self.path, self.total, self.shares, self.n = BestTags(finder.tagger.p["trans"]), None, None, 0

    def _push(self, upto: int) -> None:
        """Decode the first `upto` characters that wait, those of the text."""
        upto = min(upto, len(self.text) - self.offset - self.n)
        self.path.add(self.total[:upto] / self.shares[:upto])
        self.n += upto

    def add(self, scores: np.ndarray) -> None:
        total, shares = scores * self.weight, self.weight.copy()
        if self.total is not None:
            self._push(self.hop)
            total[: -self.hop] += self.total[self.hop :]
            shares[: -self.hop] += self.shares[self.hop :]
        self.total, self.shares = total, shares

    def spans(self) -> list[Span]:
        self._push(len(self.total))
        tags, n, spans, at = self.path.tags(), self.n, [], 0
        while at < n:
            kind = (int(tags[at]) - 1) // 2
            stop = at + 1
            if tags[at]:
                while stop < n and tags[stop] == 2 + 2 * kind:
                    stop += 1
                piece = self.text[self.offset + at : self.offset + stop]
                a = self.offset + at + len(piece) - len(piece.lstrip())
                b = a + len(piece.strip().rstrip(".,;:"))
                if b > a:
                    spans.append((kind, a, b))
            at = stop
        return spans


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, sample: int = 1000, width: int = 64, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the base patterns; spans lists these and the tagger's additions
    (kind:start:end in code points, end exclusive, by kind and start). An addition overlaps no base span.
    Null or empty texts have no spans; ids may be null or repeat; an empty table gives an empty one.
    The tagger (some 20 KB) is trained on the driver from at most `sample` windows and goes with the task.
    """
    tagger = train_tagger(docs, sample, width, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(tagger, width)
        for batch in batches:
            found = finder.find([t or "" for t in batch.column(1).to_pylist()])
            counts = [[sum(s[0] == k for s in own) for own, _ in found] for k in range(len(KINDS))]
            base = [hashlib.sha256(_joined(own).encode()).hexdigest() for own, _ in found]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array([_joined(every) for _, every in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
