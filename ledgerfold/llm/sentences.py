"""Sentence units of texts in any script and layout.

Characters are tagged boundary or inside by a linear-chain model and Viterbi
decoding. Only characters after an end mark, a paragraph mark's neighbour or, in
scripts without end marks, a blank between two words can be a boundary, so the
chain is decoded over those alone; all others are inside. Tags that the layout
decides (line and paragraph ends, claims, quoted and bracketed stretches) enter
as constraints of the decoding.

The weights come from texts that are laid out with one sentence a line
(:mod:`ledgerfold.llm.train_sentences`); scripts without end marks are learned
as they are written.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of scripts that write sentences without end marks.
BARE = "ก-๛ກ-ໟ"
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n|\n(?=SEQ ID NO)")
_LINE = re.compile(r"\n(?![ \t]+\S)")
_HEADED = re.compile(r"\s*ABSTRACT\r?\n(?![ \t\r]*\n)")
_CLAIM = re.compile(r"(?:【請求項|\[청구항 ?|【청구항 ?|(?<![\w.,])(?=[0-9]))([0-9]+)(?:[】\]]| ?[.．、)-](?=[ \t]*[^\W\d]|[ \t]*[(\[\"「“«]))")
_SEQUENCE = re.compile(r"(?<!\S)SEQ ID NO")
_QUOTE = re.compile(r'["«»„“”「」『』()（）\[\]【】]')
_OPENER = {"»": "«", "」": "「", "』": "『", ")": "(", "）": "（", "]": "[", "】": "【"}
#: A text in which letters came through as question marks, and quotations there.
_LOST = re.compile(r"[A-Za-z]\?[a-z]")
#: Quotations whose marks were lost too: what closes one also ends questions, so no more than this is taken for one.
_LOST_SPAN = re.compile(r"(?<=[^\s.!?:] )\?(?!C\b)(?=[^\W\d_a-z])[^\n]{0,120}?[\w.!]\?(?=[ ,.;])|(?<=[^\s.!?] )\? [^\n?]{1,40}?(?:\?[^\n?]{1,40}?){0,6}?[.!] \?(?= )")
_AT = re.compile(r"[.!?…؟।॥۔።፧։。！？．។៕။༎][^\w\s\[(„«「『“（【]*")
#: End marks that need no blank after them.
_WIDE_MARKS = "。！？．។៕။༎"
#: End marks of scripts that the labelled texts don't have, as marks of the same use that they have.
_SAME_MARK = str.maketrans({"॥": "।", "۔": ".", "።": "।", "፧": "?", "։": "।", "។": "。", "៕": "。", "။": "。", "༎": "。"})
#: End marks with no blank between two sentences; an abbreviation's single letter before them is none.
_GLUED = re.compile(r"(?<!(?<![^\W_])[^\W\d_])(?<=[^\s_.!?…(\[„«“])[.!?…]+[)\]\"”»]*(?=[A-Za-zÀ-\u0dff])(?=[^\W\d_]{2}|A[ -])")
_BARE_BLANK = re.compile(rf"(?<=[{BARE}]) +(?=[{BARE}])")
_GOES_ON = ";；:：,，、"
_PARAGRAPH = re.compile(r"\[[0-9]{4,}\]|【[0-9０-９]{4,}】")
_OTHER_BLANK = re.compile(r"[\t\x0b\x0c\x1c-\x1f\x85\u1680\u2000-\u200a\u2028\u2029\u202f\u205f]")
_DIGITS = re.compile(r"[0-9０-９]+")
#: What holds of a place besides the words around it: question marks may stand for lost letters; no blank parts the words.
LOST, GLUED = 1, 2
Key = tuple[str, int, str]
_OPENING = "(\"«„“「（[¿¡'"
_CLOSERS = "\"»”’')]）」』"
_MARKS = _CLOSERS + ".!?…؟।॥۔።፧։。！？．។៕။༎"
#: Titles, whose full stop parts them from the name and ends no sentence.
_TITLES = frozenset("mr mrs ms dr prof gen col maj capt cpt lt sgt rev hon sen rep gov sr sra srta dra mme mlle mgr hr frl проф акад डॉ श्री د".split())


def _class(ch: str) -> str:
    o = ord(ch)
    if ch.isdigit():
        return "0"
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0x0F00 <= o <= 0x109F or 0x1780 <= o <= 0x17FF:
        return "h"  # scripts that write without blanks but with end marks
    if 0x0E01 <= o <= 0x0EDF:
        return "t"
    if 0xAC00 <= o <= 0xD7A3:
        return "k"
    if ch.isupper():
        return "A"
    if ch.islower():
        return "a"
    if ch.isalpha():
        return "l"
    return ch


def features(before: str, how: int, after: str) -> list[str]:
    """Features of a place between ``before`` (ending in the end marks, if any) and ``after``; see :func:`places` for ``how``."""
    before = before.translate(_SAME_MARK)
    core = before.rstrip(_MARKS)
    marks = before[len(core) :]
    end = marks.lstrip(_CLOSERS)[:1]
    if how & LOST and end == "?":
        end, marks = "L", "L" + marks
    core = core.lstrip(_OPENING)
    last, first = (_class(core[-1]) if core else "-"), _class(after[0])
    bare = first in "ht" or last in "ht"
    word = "" if bare else core.lower()
    nxt = after[:1] if bare else after.rstrip("\"»”’').,;:!?؟،؛").lower()
    second = _class(after[1]) if len(after) > 1 else "-"
    kind = "i" if len(core) == 1 and core.isalpha() else "d" if core and not any(c.isalpha() for c in core) else "." if "." in core else "w"
    out = [f"e{end}|{first}", f"e{end}|{last}|{first}", f"m{marks}|{first}", f"k{kind}|{end}|{first}", f"k{kind}|{end}|{first}{second}", f"c{core[-1:]}|{end}|{first}", f"x{marks[-1:]}|{first}"]
    if not bare:
        out += [f"w{word}|{end}", f"w{word}|{first}", f"n{end[:1] == 'L'}{nxt}", f"w{word}|n{nxt}"]
    return ["G" + f for f in out] if how & GLUED else out


class Model:
    """Weights of the chain: of features for the tag boundary, and of pairs of neighbouring tags."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self._known: dict[Key, float] = {}

    @classmethod
    @cache
    def stored(cls) -> Model:
        raw = json.loads(resources.files("ledgerfold.llm").joinpath("sentence_weights.json").read_text("utf-8"))
        return cls(raw["weights"], raw["moves"])

    def score(self, key: Key) -> float:
        s = self._known.get(key)
        if s is None:
            w = self.weights
            before, how, after = key
            plain = (_DIGITS.sub("0", before), how, _DIGITS.sub("0", after))
            s = self._known.get(plain)
            if s is None:
                s = sum(w.get(f, 0.0) for f in features(*plain))
            if len(self._known) < 500_000 and len(before) + len(after) < 100:  # memory only; the score is the same
                self._known[key] = self._known[plain] = s
        return s

    def tags(self, keys: list[Key]) -> list[int]:
        """Best tags by Viterbi, 1 for boundary."""
        (ii, ib), (bi, bb) = self.moves
        inside, bound = 0.0, -1e9
        back: list[tuple[int, int]] = []
        for key in keys:
            s = self.score(key)
            from_i = (inside + ii, bound + bi)
            from_b = (inside + ib, bound + bb)
            back.append((int(from_i[1] > from_i[0]), int(from_b[1] > from_b[0])))
            inside, bound = max(from_i), max(from_b) + s
        tag = int(bound > inside)
        out = []
        for step in reversed(back):
            out.append(tag)
            tag = step[tag]
        return out[::-1]


def _spans(flat: str, lo: int, hi: int, lost: bool = False) -> list[tuple[int, int]]:
    """Quoted and bracketed stretches of ``flat[lo:hi]`` that lie in no other, in order.

    A mark goes with the one that closes it, however far off; one that nothing
    closes opens no stretch. Where marks were ``lost``, stretches between question
    marks are guessed, up to the bound of ``_LOST_SPAN``.
    """
    closed: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    straight = -1
    for m in _QUOTE.finditer(flat, lo, hi):
        i, ch = m.start(), m.group()
        if ch == '"':
            if straight >= 0:
                closed[straight] = i + 1
            straight = i
            continue
        at = open_at.setdefault(_OPENER.get(ch, "“" if ch in "„“”" else ch), [])
        if ch in _OPENER or ch == "”" or (ch == "“" and at and flat[at[-1]] == "„"):
            if at:
                closed[at.pop()] = i + 1
        else:
            at.append(i)
    starts = sorted(closed)
    out: list[tuple[int, int]] = []
    end, k = lo, 0
    guess = _LOST_SPAN.search(flat, lo, hi) if lost else None
    while True:
        while k < len(starts) and starts[k] < end:
            k += 1
        if guess and guess.start() < end:
            guess = _LOST_SPAN.search(flat, end, hi)
        if guess and (k == len(starts) or guess.start() < starts[k]):
            end = guess.end()
            out.append((guess.start(), end + 2 * flat[end + 1 : end + 2].islower()))
        elif k < len(starts):
            end = closed[starts[k]]
            out.append((starts[k], end))
        else:
            return out


def places(flat: str, lo: int, hi: int, lost: bool) -> list[tuple[int, Key]]:
    """Places in ``flat[lo:hi]`` where a unit could begin, quoted and bracketed stretches left out, with what tells about each.

    That is the word before with its end marks, ``LOST`` and ``GLUED`` as they hold,
    and the word after. A word reaches to the next blank or place, so all words
    together are read once, however long they are.
    """
    ends = []
    for m in _AT.finditer(flat, lo, hi):
        e = m.end()
        if e < hi and (flat[e] == " " or flat[m.start()] in _WIDE_MARKS):
            ends.append(e)
    glued = {m.end() for m in _GLUED.finditer(flat, lo, hi) if not (lost and "?" in m.group())}
    more = set(glued)
    if not flat.isascii():
        more.update(m.start() for m in _BARE_BLANK.finditer(flat, lo, hi))
    for m in _PARAGRAPH.finditer(flat, lo + 1, hi):
        e = m.start()
        while e > lo and flat[e - 1] == " ":
            e -= 1
        more.add(e)
    if more:
        ends = sorted(more.union(ends))
    if not ends:
        return []
    spans = _spans(flat, lo, hi, lost)
    out = []
    at, n, known = 0, len(spans), lo
    for k, e in enumerate(ends):
        p = e
        while p < hi and flat[p] == " ":
            p += 1
        if p >= hi or e <= lo:
            continue
        since, known = known, p
        while at < n and spans[at][1] <= p:
            at += 1
        if at < n and spans[at][0] < p:
            continue
        before = flat[max(since, flat.rfind(" ", since, e) + 1) : e]
        j = k + 1
        while j < len(ends) and ends[j] <= p:
            j += 1
        until = ends[j] if j < len(ends) else hi
        cut = flat.find(" ", p, until)
        after = flat[p : until if cut < 0 else cut]
        if after[0] > "\u0e00" or before[:1] > "\u0e00":  # words there have no blanks around them, so less of them is told
            core = before.rstrip(_MARKS)
            before, after = core[-2:] + before[len(core) :], after[:2]
        if before.endswith(".") and before[:-1].lstrip(_OPENING).lower() in _TITLES or lost and before.endswith("?") and after[0].islower():
            continue
        out.append((p, (before, LOST * lost + GLUED * (e in glued), after)))
    return out


def _claims_inside(flat: str, lo: int, hi: int) -> list[int]:
    """Starts of claims 1, 2, ... that run on within one line: for each number the last place before the next claim."""
    found: dict[int, list[int]] = {}
    spans = _spans(flat, lo, hi)
    at, n = 0, len(spans)
    for m in _CLAIM.finditer(flat, lo, hi):
        p = m.start()
        while at < n and spans[at][1] <= p:
            at += 1
        if at < n and spans[at][0] < p:
            continue
        h = p
        while h > lo and flat[h - 1] == " ":
            h -= 1
        head = flat[h - 1 : h] if h > lo else ""
        if not head or head in _MARKS or m.group()[0] == "[" or ord(m.group()[0]) > 127 or BARE[0] <= head <= BARE[-1]:
            found.setdefault(int(m.group(1)), []).append(p)
    for n in sorted(found, reverse=True):
        end, chain = hi, []
        for k in range(n, 0, -1):
            at = bisect_left(found.get(k, []), end) - 1
            if at < 0:
                break
            end = found[k][at]
            chain.append(end)
        if len(chain) == n:
            return chain[::-1]
    return []


def _blocks(text: str) -> list[tuple[int, int, bool]]:
    """Stretches that the layout separates: paragraphs where blank lines part them, else lines; and whether there is no other but sequences."""
    lo, hi = len(text) - len(text.lstrip()), len(text.rstrip())
    out: list[tuple[int, int, bool]] = []
    headed = _HEADED.match(text)
    blank = _BLANK_LINE.search(text, headed.end(), hi) if headed else None
    if blank:  # an abstract in another language, set before a text that has its own layout
        out += [(a, b, False) for a, b in _cut(text, _LINE, lo, blank.start())]
        lo = blank.end()
    m = re.search(r"\n[ \t\r]*\n", text[lo:hi].lstrip())
    rest = _cut(text, _BLANK_LINE if m else _LINE, lo, hi)
    alone = sum(not text.startswith("SEQ ID NO", a) for a, _ in rest) == 1
    return out + [(a, b, alone) for a, b in rest]


def _cut(text: str, pattern: re.Pattern, lo: int, hi: int) -> list[tuple[int, int]]:
    out = []
    for m in pattern.finditer(text, lo, hi):
        out.append((lo, m.start()))
        lo = m.end()
    return [(a, b) for a, b in [*out, (lo, hi)] if a < b]


def _flat(text: str) -> str:
    """The text with each white-space character as a blank."""
    text = text.replace("\n", " ").replace("\r", " ").replace("\xa0", " ").replace("\u3000", " ")
    return _OTHER_BLANK.sub(" ", text) if _OTHER_BLANK.search(text) else text


def segment(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Units of a text as (start, end) in code points, in order; none for NULL, empty or blank texts."""
    if not text or text.isspace():
        return []
    flat = _flat(text)
    lost = _LOST.search(flat) is not None
    starts: list[int] = []
    ends: list[int] = []
    due = 1
    for lo, hi, alone in _blocks(text):
        while lo < hi and flat[lo] == " ":
            lo += 1
        while hi > lo and flat[hi - 1] == " ":
            hi -= 1
        if lo >= hi:
            continue
        cuts = [lo]
        claim = _CLAIM.match(flat, lo, hi)
        numbered = not alone and claim and int(claim.group(1)) in (due, 1)
        if due > 1 and not numbered and flat[ends[-1] - 1] in _GOES_ON:  # a sub-item on a line of its own
            ends[-1] = hi
            continue
        if numbered:
            due = int(claim.group(1)) + 1
            cuts += [m.start() for m in _SEQUENCE.finditer(flat, lo + 1, hi)]
        elif flat.startswith("SEQ ID NO", lo):
            pass
        else:
            sequences = [m.start() for m in _SEQUENCE.finditer(flat, lo, hi)]
            end = sequences[0] if sequences else hi
            claims = _claims_inside(flat, lo, end) if alone else []
            prose = claims[0] if claims else end
            found = list(places(flat, lo, prose, lost))
            if found:
                tags = model.tags([key for _, key in found])
                cuts += [p for (p, _), tag in zip(found, tags, strict=True) if tag]
            cuts += [p for p in claims + sequences if p > lo]
        starts += cuts
        ends += [*cuts[1:], hi]
    out = []
    for s, e in zip(starts, ends, strict=True):
        while e > s and flat[e - 1] == " ":
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sent_start, sent_end)``: each unit of each text, positions in code points from 0.

    NULL, empty and blank texts have no units. Repeated rows give repeated units.
    Texts are taken whole, each in one piece; a row's work is linear in its
    length. Other columns are ignored. There is no shuffle: units are made where the texts are read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.stored()
        for b in batches:
            rows: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e in segment(t, model):
                    rows.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, "sent_start", "sent_end"])

    return docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, sent_start int, sent_end int")
