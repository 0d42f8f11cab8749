"""Fit the sentence model: python -m ledgerfold.llm.train_sentences FOLDER [WEIGHTS].

Labelled rows are texts laid out with one sentence a line: no blank lines, and
no line with a place that is plainly between two sentences. Their lines, run
together, give sequences whose true boundaries are known; they are used once more
with their non-ASCII letters lost, as some texts come. At most ``MOST_ROWS``
such texts are used, in order of a hash of their id; every tenth is held out
before any text is left out of training, and all of it is measured. Scripts
without end marks are learned as they are written.
The fit is an averaged structured perceptron with Viterbi decoding.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq

from ledgerfold.llm.sentences import _CLAIM, _DIGITS, _GLUED, _LOST, BARE, Key, Model, _flat, features, places

#: Bound of the labelled sample.
MOST_ROWS = 16000
EPOCHS = 8
#: One pair of sentences in so many is run together without a blank.
GLUE_EACH = 4
#: Rounds of fitting after which texts that turn out to have another layout are left out.
ROUNDS = 2
#: Lines without an end mark that are shorter than this are titles or headings (not in scripts that have no end marks).
_END = re.compile(r"[.!?…؟।。！？．][\"»”’')\]」』]*$")
_PLAIN = re.compile(rf"[^\W\d_]{{5,}}[.!?؟।][\"»”]? +[A-ZÀ-ÞА-Я؀-ۿऀ-ॿ가-힣][^\W\d_]+ [^\W\d_]|[。！？](?=[^」』”）\s])|[{BARE}] +[{BARE}]")
_QUOTED = re.compile(r'"[^"]*"|«[^»]*»|„[^“”]*[“”]|“[^”]*”|「[^」]*」|\([^()]*\)|（[^（）]*）|\[[^\]]*\]')


def labelled(text: str) -> list[list[str]]:
    """Runs of sentences of a text with one sentence a line; none if it isn't laid out so."""
    if not text or re.search(r"\n[ \t\r]*\n", text) or text.count("\n") < 6:
        return []
    runs: list[list[str]] = [[]]
    bare = re.search(rf"[{BARE}]", text) is not None
    for i, line in enumerate(x.strip() for x in text.split("\n")):
        head = (len(line) < 60 and not re.search(r"[0-9]", line) and i > 0) if bare else not _END.search(line)
        if i == 0 or not line or head or _CLAIM.match(line) or line.startswith("SEQ ID NO"):
            runs.append([])
            continue
        if _PLAIN.search(_QUOTED.sub("_", line)):
            return []
        runs[-1].append(line)
    if bare:  # headings and short sentences look alike without end marks
        runs = [r for r in runs if len(r) > 1]
    return [r for r in runs if len(r) > 1]


def sequence(run: list[str]) -> tuple[list[Key], list[int]]:
    """Places of a run of sentences, and which of them are boundaries. Every ``GLUE_EACH``-th pair has no blank between, as some texts come."""
    glue = "" if re.search(r"[぀-ヿ一-鿿]", run[0]) and not re.search(r"[가-힣]", run[0]) else " "
    flat, true = "", set()
    for i, s in enumerate(run):
        bare = (i + len(run[0])) % GLUE_EACH == 0 and _GLUED.search(flat[-3:] + s[:3])
        flat += ("" if bare else glue) if flat else ""
        true.add(len(flat))
        flat += _flat(s)
    found = list(places(flat, 0, len(flat), _LOST.search(flat) is not None))
    return [(_DIGITS.sub("0", before), how, _DIGITS.sub("0", after)) for _, (before, how, after) in found], [int(p in true) for p, _ in found]


def damaged(runs: list[list[str]]) -> list[list[str]]:
    """The same runs as they read after a conversion that knew only ASCII; none if that would leave little of them."""
    text = "".join(map("".join, runs))
    out = [[re.sub(r"[^\x00-\x7f]", "?", s) for s in run] for run in runs]
    return out if _LOST.search("".join(map("".join, out))) and sum(c > "\x7f" for c in text) < 0.1 * len(text) else []


def fit(data: list[tuple[list[Key], list[int]]], seed: int = 7) -> Model:
    total: dict[str, float] = defaultdict(float)
    last: dict[str, int] = defaultdict(int)
    model = Model(defaultdict(float), [[0.0, 0.0], [0.0, 0.0]])
    moves_sum = [[0.0, 0.0], [0.0, 0.0]]
    t = 0

    def add(f: str, by: float) -> None:
        total[f] += (t - last[f]) * model.weights[f]
        last[f] = t
        model.weights[f] += by

    rng = random.Random(seed)
    for _ in range(EPOCHS):
        rng.shuffle(data)
        for keys, gold in data:
            t += 1
            model._known.clear()
            got = model.tags(keys)
            if got != gold:
                for key, g, h in zip(keys, got, gold, strict=True):
                    if g != h:
                        for f in features(*key):
                            add(f, h - g)
                for tags, by in ((gold, 1.0), (got, -1.0)):
                    for a, b in zip([0, *tags], tags, strict=False):
                        model.moves[a][b] += by
            for a in (0, 1):
                for b in (0, 1):
                    moves_sum[a][b] += model.moves[a][b]
    weights = {f: round((total[f] + (t + 1 - last[f]) * w) / (t + 1), 3) for f, w in model.weights.items()}
    return Model({f: w for f, w in weights.items() if w}, [[round(x / t, 3) for x in row] for row in moves_sum])


def fitted(texts: list[list[tuple[list, list[int]]]]) -> tuple[Model, list, list]:
    """The model, the texts that it was fitted on and the held-out tenth, which is set aside first and left whole."""
    held, train = texts[::10], [text for i, text in enumerate(texts) if i % 10]
    for _ in range(ROUNDS):  # a text that still has a boundary within a line was not laid out one sentence a line
        model = fit([d for text in train for d in text])
        train = [text for text in train if not any(g > h for keys, gold in text for g, h in zip(model.tags(keys), gold, strict=True))]
    return fit([d for text in train for d in text]), train, held


def main(folder: str, out: str | None = None) -> None:
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows.sort(key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest())
    kept = [runs for r in rows if (runs := labelled(r["text"]))][:MOST_ROWS]
    texts = [[d for run in runs + damaged(runs) if (d := sequence(run))[0]] for runs in kept]
    model, train, held = fitted(texts)
    wrong = [(k, g) for text in held for keys, gold in text for k, g, h in zip(keys, gold, model.tags(keys), strict=True) if g != h]
    places_in = lambda some: sum(len(k) for text in some for k, _ in text)
    print(f"{len(texts)} labelled texts, {len(held)} held out, {len(texts) - len(held) - len(train)} removed from training, {places_in(train)} places; held out: {len(wrong)} wrong ({sum(not g for _, g in wrong)} inside, {sum(g for _, g in wrong)} boundaries) of {places_in(held)}; {len(model.weights)} weights, moves {model.moves}")
    for w in wrong[:40]:
        print("  ", w)
    raw = {"moves": model.moves, "weights": dict(sorted(model.weights.items()))}
    (Path(out) if out else Path(__file__).with_name("sentence_weights.json")).write_text(json.dumps(raw, ensure_ascii=False, indent=0), "utf-8")


if __name__ == "__main__":
    main(*sys.argv[1:3])
