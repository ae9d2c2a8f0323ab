"""Personal data by a semi-Markov conditional random field.

A text's candidate segments are whole spans: groups of digits with separators, and what stands around a mark such as ``@`` or ``(at)``. Each is scored as a whole, for
each kind that it could be, by features of its digits, groups, separators, checksum, borders and the word before it. A
dynamic program over the ends of the candidates chooses boundaries and kinds together: the best set of segments that don't overlap, with a score for each kind
after the kind before. Text outside the candidates scores zero, and candidates have a bounded length, so the program
is exact and its work follows the text.

The base rules fix some segments: what they match is a candidate with its kind given and enters every solution. Base matches that overlap another one stay
beside the solution. A segment that is not a base match is added only if it beats its absence by ``CAUTION``.

The field is trained here, by its conditional likelihood: forward and backward sums over the same candidates. Its labels are those of
the base rules on at most ``windows`` snippets of the texts, those with the least hashes; into the same surroundings it also puts other spellings of each
kind (marked), and look-alikes (unmarked): dates, versions, prices, serial numbers, card numbers with a wrong checksum.

Results in special cases: a null or empty text has no spans; very long texts are scanned whole; repeated rows each get their row; a null id
stays null; an empty table gives an empty result (and trains on the made-up spellings alone); columns other than the id and the text are
never read.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_map, blocks

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: How far a segment beyond the base rules has to beat its absence, in log odds.
CAUTION = 1.5
#: Code points of a segment that is no base match; base matches have any length.
LONGEST = 64
#: Snippets that the field is trained on.
WINDOWS = 800

# --- base rules

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match starts at the first digit of its run: from a later one it would start at the first as well
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum((2 * int(c)) % 10 + (c > "4") for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind and start."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            found.append((EMAIL, start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    found += [(IP, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    found += [(CARD, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    found += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


# --- candidates

#: Digits with at most three separators between two of them.
_RUN = re.compile(r"[+(]{0,2}[0-9](?:[ ().+/-]{0,3}[0-9])*")
_GROUP = re.compile(r"[0-9]+")
_OCTETS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
#: What may stand for the mark of an address and for its dots.
_MARK = re.compile(r"\s?@\s?|\s?[\[({]\s?(?:at|@)\s?[\])}]\s?| at (?=[a-z0-9-]+ dot )", re.IGNORECASE)
_TAIL = re.compile(r"[A-Za-z0-9-]+")
_DOT = re.compile(r"\.(?=[A-Za-z0-9])|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?| dot ", re.IGNORECASE)
_DOT_BEFORE = re.compile(r".*?((?:[A-Za-z0-9_%+-]+)(?: dot |\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?))$", re.IGNORECASE | re.DOTALL)
#: A text without any of these has neither candidates nor base matches.
TRIGGER = r"[0-9@]|[\[({]\s?[aA][tT]\s?[\])}]| [aA][tT] [A-Za-z0-9-]+ [dD][oO][tT] "


def _free(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit stands beside a segment."""
    return not (start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum())


def candidates(text: str) -> list[tuple[int, int, tuple[int, ...]]]:
    """Segments (start, end, the kinds that each could be), each once."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for run in _RUN.finditer(text):
        low, high = run.span()
        groups = [m.span() for m in _GROUP.finditer(text, low, high)]
        if high - low < 7 or sum(e - s for s, e in groups) < 7:
            continue
        for i, (first, _) in enumerate(groups):
            starts = [first]
            while starts[-1] > low and text[starts[-1] - 1] in "+(":
                starts.append(starts[-1] - 1)
            n = 0
            for s, end in groups[i:]:
                n += end - s
                if n > 19 or end - first > LONGEST:
                    break
                if n < 7:
                    continue
                for start in starts:
                    if _free(text, start, end):
                        kinds = (IP,) * bool(_OCTETS.fullmatch(text, start, end)) + (CARD,) * (n >= 13) + (PHONE,) * (n <= 15)
                        found[start, end] = kinds
    for mark in _MARK.finditer(text):
        low = mark.start()
        start = low
        while start and low - start < LONGEST // 2 and text[start - 1] in _LOCAL:
            start -= 1
        if start == low:
            continue
        starts = [start]
        while len(starts) < 4 and (m := _DOT_BEFORE.match(text, max(0, starts[-1] - 24), starts[-1])):
            starts.append(m.start(1))
        label, ends = _TAIL.match(text, mark.end()), []
        while label and len(ends) < 6 and (dot := _DOT.match(text, label.end())):
            label = _TAIL.match(text, dot.end())
            if label:
                ends.append(label.end())
        for s in starts:
            for e in ends:
                if e - s <= LONGEST and _free(text, s, e):
                    found[s, e] = (EMAIL,)
    return sorted((s, e, kinds) for (s, e), kinds in found.items())


_WORD_BEFORE = re.compile(r"([A-Za-z]{1,12})[^A-Za-z0-9]{0,3}$")
_ALNUM = re.compile(r"[A-Za-z0-9_%-]+")


def features(text: str, start: int, end: int) -> list[str]:
    """The names of a whole segment's features."""
    own = text[start:end]
    before, after = text[max(0, start - 16) : start], text[end : end + 1]
    side = lambda c: "edge" if not c else "space" if c.isspace() else c if c in ",.;:!?()[]{}\"'#$%&*/\\=+-_@" else "other"
    word = _WORD_BEFORE.search(before)
    out = ["any", f"before {side(before[-1:])}", f"after {side(after)}", f"word {word[1].lower() if word else ''}"]
    if "@" in own or any(c.isalpha() for c in own):
        shape = _ALNUM.sub("w", own)
        return [*out, f"shape {shape.lower()[:24]}", f"labels {shape.count('w')}", f"marks {'@' in own} {' ' in own}", f"last {min(6, len(own) - len(own.rstrip('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')))}"]
    digits = digits_of(own)
    n = len(digits)
    groups = _GROUP.findall(own)
    out += [f"n {n}", f"shape {_GROUP.sub(lambda m: str(len(m[0])), own)[:32]}", f"groups {'-'.join(str(len(g)) for g in groups[:8])}", f"between {''.join(sorted(set(own) - set('0123456789')))}", f"first {own[0]}", f"n {n} first {digits[0]}"]
    if n >= 13:
        out += [f"luhn {luhn(digits)}", f"luhn {luhn(digits)} {n}"]
    if len(groups) == 4 and own.count(".") == 3:
        out.append(f"octets {all(int(g) <= 255 for g in groups)}")
    return out


# --- the field


@dataclass
class Field:
    """Weights of features by kind, and of a kind after the kind before (the last row: none before)."""

    weights: dict[str, list[float]] = field(default_factory=dict)
    after: list[list[float]] = field(default_factory=lambda: [[0.0] * 4 for _ in range(5)])

    def score(self, text: str, start: int, end: int) -> list[float]:
        rows = [w for f in features(text, start, end) if (w := self.weights.get(f)) is not None]
        return [sum(x) for x in zip(*rows, strict=True)] if rows else [0.0] * 4

    def decode(self, text: str, base: list[tuple[int, int, int]], caution: float = CAUTION) -> list[tuple[int, int, int]]:
        """The best segments: (kind, start, end). ``base`` matches are given candidates that no other may displace."""
        taken = sorted((s, e) for _, s, e in base)
        least = [s for s, _ in taken]
        reach = list(np.maximum.accumulate([e for _, e in taken])) if taken else []

        def clear(start: int, end: int) -> bool:
            """Whether a segment overlaps no base match."""
            k = bisect.bisect_left(least, end)
            return not k or reach[k - 1] <= start

        rows = [(s, e, ((k, scores[k] - caution),)) for s, e, kinds in candidates(text) if clear(s, e) for scores in (self.score(text, s, e),) for k in kinds]
        rows += [(s, e, ((k, 1e6),)) for k, s, e in base]
        if not rows:
            return []
        rows.sort(key=lambda r: (r[1], r[0]))
        # best[i]: for each kind of the last segment so far, the best score up to the i-th end, and how it came about
        ends: list[int] = [0]
        best: list[list[tuple[float, tuple | None]]] = [[(-1e18, None)] * 4 + [(0.0, None)]]
        for s, e, options in rows:
            if e > ends[-1]:
                ends.append(e)
                best.append(best[-1][:])
            here = best[-1]
            from_ = best[bisect.bisect_right(ends, s) - 1]
            for k, score in options:
                top, back = max(((from_[last][0] + self.after[last][k], from_[last][1]) for last in range(5)), key=lambda x: x[0])
                if top + score > here[k][0]:
                    here[k] = (top + score, (k, s, e, back))
        chain = max(best[-1], key=lambda x: x[0])[1]
        found = []
        while chain is not None:
            found.append(chain[:3])
            chain = chain[3]
        return found

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """All spans by kind, start and end: those of the best segmentation, and base matches that overlap one of them."""
        return sorted({*self.decode(text, base), *base})


def _log_sum(values: np.ndarray) -> float:
    top = values.max()
    return top + np.log(np.exp(values - top).sum())


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> Field:
    """The field whose segmentations of the examples' texts are likeliest to be those given: (kind, start, end) for each.

    Stochastic gradient steps with rates for each weight (AdaGrad). An example whose segments are no candidates is left out.
    """
    names: dict[str, int] = {}
    seen = []
    for text, gold in examples:
        rows = [(s, e, kinds, np.array([names.setdefault(f, len(names)) for f in features(text, s, e)])) for s, e, kinds in candidates(text)]
        rows.sort(key=lambda r: (r[1], r[0]))
        marks = {(s, e): k for k, s, e in gold}
        if rows and all(any(marks.get((s, e)) == k for s, e, kinds, _ in rows for k in kinds if (s, e) == (g, h)) for k, g, h in gold):
            seen.append((rows, marks))
    w, after = np.zeros((len(names), 4)), np.zeros((5, 4))
    w_seen, after_seen = np.full_like(w, 1e-6), np.full_like(after, 1e-6)
    pick = random.Random(seed)
    for _ in range(epochs):
        pick.shuffle(seen)
        for rows, marks in seen:
            places = sorted({e for _, e, _, _ in rows} | {0})
            start = [bisect.bisect_right(places, s) - 1 for s, _, _, _ in rows]
            end = [bisect.bisect_left(places, e) for _, e, _, _ in rows]
            score = [np.where(np.isin(np.arange(4), kinds), w[ids].sum(0), -1e9) for _, _, kinds, ids in rows]
            forward = np.full((len(places), 5), -1e9)
            forward[0, 4] = 0
            k = 0
            for p in range(1, len(places)):
                forward[p] = forward[p - 1]
                while k < len(rows) and end[k] == p:
                    into = np.array([_log_sum(forward[start[k]] + after[:, y]) for y in range(4)])
                    forward[p, :4] = np.logaddexp(forward[p, :4], into + score[k])
                    k += 1
            backward = np.full((len(places), 5), -1e9)
            backward[-1] = 0
            by_start: dict[int, list[int]] = {}
            for i, p in enumerate(start):
                by_start.setdefault(p, []).append(i)
            for p in range(len(places) - 1, -1, -1):
                if p < len(places) - 1:
                    backward[p] = backward[p + 1]
                for i in by_start.get(p, ()):
                    backward[p] = np.logaddexp(backward[p], np.array([_log_sum(after[last] + score[i] + backward[end[i], :4]) for last in range(5)]))
            total = _log_sum(forward[-1])
            last = 4
            for i, (s, e, _, ids) in enumerate(rows):
                likely = np.exp(np.minimum(forward[start[i]][:, None] + after + score[i][None, :] + backward[end[i], :4][None, :] - total, 0))
                step, step_after = -likely.sum(0), -likely
                if (s, e) in marks:
                    y = marks[s, e]
                    step[y] += 1
                    step_after[last, y] += 1
                    last = y
                step = step - decay * w[ids].sum(0) / len(ids)
                np.add.at(w_seen, ids, step**2)
                np.add.at(w, ids, rate * step / np.sqrt(w_seen[ids] + 1e-3))
                after_seen += step_after**2
                after += rate * step_after / np.sqrt(after_seen + 1e-3) * (np.abs(step_after) > 1e-9)
    order = sorted(names, key=names.__getitem__)
    return Field({f: w[i].tolist() for i, f in enumerate(order) if np.abs(w[i]).max() > 1e-3}, after.tolist())


# --- labels


def _numbers(pick: random.Random, shape: str) -> str:
    """``shape`` with each 9 as a digit, and each 8 as one over 0."""
    return "".join(str(pick.randint(0, 9)) if c == "9" else str(pick.randint(1, 9)) if c == "8" else c for c in shape)


def _checked(pick: random.Random, shape: str, right: bool) -> str:
    """Digits in the given shape that pass the checksum, or just fail it."""
    while True:
        made = _numbers(pick, shape)
        if luhn(digits_of(made)) == right:
            return made


#: Spellings of each kind beyond the base rules, and look-alikes; 9 and 8 stand for digits. Words that may stand before a kind.
PHONES = ("(899) 999-9999", "899-999-9999", "899.999.9999", "899 999 9999", "1-899-999-9999", "1 (899) 999-9999", "0089 899 9999999", "089/9999999", "0899 999999", "(089) 9999999", "089-9999999")
CARDS = ("3499 999999 99999", "3799-999999-99999", "379999999999999", "4999.9999.9999.9999", "5899.9999.9999.9999", "4999  9999  9999  9999", "4999/9999/9999/9999")
LOOKALIKES = (
    "2099-18-28", "28.18.2099", "8/18/2099", "2099-18-28 18:89", "1899-1999", "1999-2099", "89.999.999", "8.999.999.999", "8999.99", "899999.9999", "8.89.899.9999", "899.999.9.9999", "978-9-99-999999-9", "899999999", "8999999999", "89999999999",
    "8999999999999", "20991828999999", "999-99-9999-999", "89 89 89 89 89 89", "8 9 8 9 8 9 8 9 8", "8999-8999", "8999 8999", "8-8-8-8-8-8-8-8", "899/999/999/999", "89.9999, 8.999999", "899999-999", "8999 999",
)
CUES = (("email", "mail", "contact", "write"), ("ip", "host", "server", "address"), ("card", "visa", "mastercard", "credit"), ("phone", "tel", "call", "fax", "mobile"))
AMONG = ("the page", "order", "item", "number", "version", "on", "in", "and", "")


def _spelling(pick: random.Random, kind: int) -> str:
    if kind == EMAIL:
        user = pick.choice(["anna", "j", "info", "max.b", "team-x", "k_l"]) + pick.choice(["", ".", "42", "7"]).rstrip(".")
        host, top = pick.choice(["mail", "site7", "a-b", "example"]), pick.choice(["com", "org", "net", "de"])
        return pick.choice([f"{user}@{host}.{top}", f"{user}@m.{host}.{top}", f"{user} (at) {host} (dot) {top}", f"{user} at {host} dot {top}", f"{user}[at]{host}.{top}", f"{user} @ {host}.{top}", f"{user} [at] {host} [dot] {top}", f"{user}(at){host}.{top}"])
    if kind == IP:
        return ".".join(str(pick.randint(0, 255)) for _ in range(4))
    if kind == CARD:
        return _checked(pick, pick.choice([*CARDS, "4999 9999 9999 9999", "5899-9999-9999-9999", "8999999999999999"]), True)
    return _numbers(pick, pick.choice([*PHONES, *PHONES, "+8 (999) 999-9999", "+89 99 9999999"]))


def examples(snippets: list[str], seed: int = 1, made: int = 1200) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training texts with their segments: the snippets as the base rules mark them, and made-up spellings between words of the snippets."""
    pick = random.Random(seed)
    found = []
    words = sorted({w for s in snippets for w in s.split() if w.isalpha()})[:2000] or ["and"]
    for text in snippets:
        spans, end = [], 0
        for k, s, e in sorted(base_spans(text), key=lambda x: (x[1], -x[2])):  # the first of overlapping ones
            if s >= end:
                spans.append((k, s, e))
                end = e
        found.append((text, spans))
    for _ in range(made):
        text, spans = pick.choice(words) + " ", []
        for _ in range(pick.choice([1, 1, 2])):
            if pick.random() < 0.5:
                kind = pick.randrange(4)
                what = _spelling(pick, kind)
                bare = kind == PHONE and pick.random() < 0.2  # a plain number is a phone's only behind a word that says so
                what = _numbers(pick, "8999999999") if bare else what
                cue = pick.choice(CUES[kind]) if bare or pick.random() < 0.4 else pick.choice([pick.choice(words), pick.choice(AMONG)])
                text += cue + pick.choice([" ", ": ", " "])
                spans.append((kind, len(text), len(text) + len(what)))
            else:
                what = _checked(pick, pick.choice([*CARDS, "4999 9999 9999 9999", "8999999999999999", "8999-9999-9999-9999"]), False) if pick.random() < 0.35 else _numbers(pick, pick.choice(LOOKALIKES))
                text += pick.choice([pick.choice(words), pick.choice(AMONG)]) + " "
            text += what + pick.choice([" ", ", ", ". ", "!! "]) + pick.choice(words) + " "
        found.append((text, spans))
    return found


# --- operators


def snippets(df: DataFrame, text_col: str = "text", windows: int = WINDOWS) -> list[str]:
    """At most ``windows`` distinct snippets of the texts around candidates and base matches, those with the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches, 0):
            found = []
            for text in _triggered(block.column(0))[1]:
                for s, e in {(s, e) for s, e, _ in candidates(text)} | {(s, e) for _, s, e in base_spans(text) if e - s <= LONGEST}:
                    low, high = text.rfind(" ", 0, max(0, s - 16)) + 1, text.find(" ", e + 12)
                    piece = text[max(low, s - 40) : min(high if high >= 0 else len(text), e + 30)]
                    found.append(piece)
            if found:
                pieces = pc.unique(pa.array(found, pa.string()))
                yield pa.RecordBatch.from_arrays([pieces], names=["piece"])

    rows = arrow_map(df, [text_col], run, "piece string").distinct().orderBy(F.xxhash64("piece"), "piece").limit(windows)
    return [r["piece"] for r in rows.collect()]


def learn(df: DataFrame, text_col: str = "text", windows: int = WINDOWS) -> Field:
    """A field trained on snippets of the texts; its size is bounded by ``windows``."""
    return fit(examples(snippets(df, text_col, windows)))


def _triggered(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Places and values of the texts that can hold a span."""
    places = np.flatnonzero(pc.match_substring_regex(texts, TRIGGER).to_numpy(zero_copy_only=False))
    return places, texts.take(pa.array(places)).to_pylist()


def find(df: DataFrame, field_: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, and ``base`` and ``spans``: its spans (kind, start, end) by kind, start and end, in code points."""
    kind = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches, 1):
            base: list[list[dict]] = [[] for _ in range(block.num_rows)]
            spans: list[list[dict]] = [[] for _ in range(block.num_rows)]
            rows = lambda found: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found]
            for i, text in zip(*_triggered(block.column(1)), strict=True):
                own = base_spans(text)
                base[i], spans[i] = rows(own), rows(field_.spans(text, own))
            of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(base, of), pa.array(spans, of)], names=[id_col, "base", "spans"])

    return arrow_map(df, [id_col, text_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, base {kind}, spans {kind}")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``find``'s rows: the id, the number of base matches of each kind, a digest of all of them, and all spans as text ``kind:start:end,...``."""
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
