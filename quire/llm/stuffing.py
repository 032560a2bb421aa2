"""Keyword-stuffed and link-list pages, found by labelling lines with a hidden Markov model.

A page is cut into lines: at its line ends, and where a line runs on, at the ends of sentences or,
without any, after a fixed number of words. Each line shows one of a few symbols made of its links,
hashtags, stuffed words (words of which the page has about one for each of its lines), share of
function words and length. The hidden states are prose, link list, tag list and menu. The model starts from a table of
what each state is likely to show and is trained by Baum-Welch on all pages, with the table as its
prior: each step sums the expected counts, sixty numbers a task. Then every page is decoded. A page
is flagged by the share of its words in lines that are not prose.

Lines are looked at once: a byte and a count a line are kept, and the steps and the decoding run over
those, many pages at a time in one array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

STATES = ("prose", "link_list", "tag_list", "menu")
SYMBOLS = ("prose", "weak_prose", "bare_long", "bare_short", "link", "hashtag", "stuffed", "stuffed_weak", "stuffed_prose", "wordless")

#: Function words of the documents' languages (en, es, fr, de, it): fixed values.
FUNCTION_WORDS = frozenset(
    """
    a about after all also although among an and any are as at be because been before between both but by can could did do does
    for from had has have he her here his how i if in into is it its may me more most my no not of on once one only or other our
    out over so some such than that the their them then there these they this those through to under until up upon us was we
    were what when where which while who will with without would you your
    al antes así aunque como con cuando de del desde donde dos durante el ella en entre era es esta este esto fue ha hacia hasta
    la las le lo los más muy ni no nos o para pero por porque que se según ser si sin sobre son su sus también tras un una uno y ya
    au aucun aux avec ce ces cette ceux chez comme dans depuis des dont du elle est et eux il ils je leur lui mais même ne nous ou
    par pas plus pour qu quand qui sa sans ses son sont sous sur une vous à été être où
    aber als am an auch auf aus bei beim bis da damit das dass dem den der des die dies diese dieser doch durch ein eine einem
    einen einer eines er es für gegen hat ich ihr im in ist kann kein keine man mit nach nicht noch nur ob oder ohne sehr sein
    seine sich sie sind so über um und unter vom von vor war was wenn werden wie wir wird wurde wurden zu zum zur zwischen
    agli alla alle anche ai che chi ci col come con cui da dagli dai dal dalla dalle dei del della delle di dopo e ed era fra gli
    ha hanno ho il io le lo ma né nei nel nella nelle noi non per perché più quando quella quello questa questo se si sia sono su
    sui sul sulla suo tra un una uno è
    """.split()
)
#: A line of more words than this is cut further.
RUN_ON = 14

_LINK = regex.compile(r"(?:https?://|www\.)\S+", regex.I)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_TAG = regex.compile(r"(?<!\w)#\w+")
_SENTENCE = regex.compile(r"(?<=[.!?;])\s+")


def lines_of(text: str) -> list[str]:
    """The lines of a page: its own, and run-on ones cut at sentence ends or else by length."""
    out = []
    for line in regex.split(r"[\r\n \u0085]+", text):
        words = line.split()
        if len(words) <= RUN_ON:
            if words:
                out.append(line)
            continue
        for part in _SENTENCE.split(line):
            words = part.split()
            if len(words) <= 3 * RUN_ON:
                if words:
                    out.append(part)
            else:
                out += [" ".join(words[i : i + RUN_ON]) for i in range(0, len(words), RUN_ON)]
    return out


def observe(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The symbol and the number of words of each line; links and hashtags count as one word each."""
    lines = lines_of(text) if text else []
    parsed, counts = [], {}
    for line in lines:
        links = len(_LINK.findall(line)) if "://" in line or "www." in line.lower() else 0
        bare = _LINK.sub(" ", line) if links else line
        tags = 0
        if "#" in bare:
            tags = len(_TAG.findall(bare))
            bare = _TAG.sub(" ", bare)
        words = [w.lower() for w in _WORD.findall(bare)]
        content = [w for w in words if w not in FUNCTION_WORDS and len(w) > 1]
        for w in content:
            counts[w] = counts.get(w, 0) + 1
        parsed.append((links, tags, len(words), content))
    often = max(5.0, 0.8 * len(parsed))
    symbols, sizes = np.zeros(len(parsed), dtype=np.int8), np.zeros(len(parsed))
    for k, (links, tags, n, content) in enumerate(parsed):
        function = (n - len(content)) / n if n else 0.0
        stuffed = sum(counts[w] >= often for w in content) / len(content) if content else 0.0
        if links and n <= 8 * links:
            s = "link"
        elif tags and n <= 3 * tags:
            s = "hashtag"
        elif not n:
            s = "wordless"
        elif stuffed >= 0.2 and function >= 0.25 and n >= 6:
            s = "stuffed_prose"
        elif stuffed >= 0.5:
            s = "stuffed"
        elif stuffed >= 0.2:
            s = "stuffed_weak"
        elif function >= 0.22 and n >= 5:
            s = "prose"
        elif function >= 0.12 or n < 5 and function > 0:
            s = "weak_prose"
        elif n > 5:
            s = "bare_long"
        else:
            s = "bare_short"
        symbols[k] = SYMBOLS.index(s)
        sizes[k] = max(1, n + links + tags)
    return symbols, sizes


def prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, transition and emission probabilities before training; documented guesses."""
    begin = np.array([0.7, 0.1, 0.1, 0.1])
    stay = 0.85
    move = np.full((4, 4), (1 - stay) / 3)
    np.fill_diagonal(move, stay)
    #                   prose weak  long  short link  hash  stuff weak  prose none
    emit = np.array(
        [
            [0.680, 0.150, 0.020, 0.050, 0.005, 0.002, 0.005, 0.013, 0.070, 0.005],
            [0.005, 0.020, 0.030, 0.060, 0.800, 0.010, 0.020, 0.020, 0.010, 0.025],
            [0.005, 0.015, 0.250, 0.170, 0.010, 0.330, 0.130, 0.060, 0.010, 0.020],
            [0.010, 0.040, 0.150, 0.200, 0.020, 0.010, 0.380, 0.100, 0.080, 0.010],
        ]
    )
    return begin, move, emit / emit.sum(1, keepdims=True)


#: Lines, with what fills shorter pages up, of one array of pages.
CELLS = 100_000


def _padded(pages: list[np.ndarray]):
    """(numbers of the pages, lengths, symbols filled up with -1) of pages of like length; pages without lines are left out."""
    size = np.array([len(p) for p in pages], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    while len(order):
        most = size[order[-1]]
        take = order[-max(1, CELLS // most) :]
        order = order[: -len(take)]
        out = np.full((len(take), most), -1, dtype=np.int64)
        out[np.arange(most) < size[take][:, None]] = np.concatenate([pages[k] for k in take])
        yield take, size[take], out


def expected(pages: list[np.ndarray], model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected numbers of beginnings by state, transitions and symbols by state, by scaled forward-backward."""
    begin, move, emit = model
    n_begin, n_move, n_emit = np.zeros(4), np.zeros((4, 4)), np.zeros((4, len(SYMBOLS)))
    for _, size, x in _padded(pages):
        b = np.where((x >= 0)[:, :, None], emit.T[x], 1.0)
        f, scale = np.empty(b.shape), np.ones(x.shape)
        for t in range(x.shape[1]):
            now = (f[:, t - 1] @ move if t else begin) * b[:, t]
            live = t < size
            scale[:, t] = np.where(live, now.sum(1), 1.0)
            f[:, t] = np.where(live[:, None], now / scale[:, t, None], 0.0)
        back = np.ones((len(x), 4))
        for t in range(x.shape[1] - 1, -1, -1):
            if t + 1 < x.shape[1]:
                live = (t + 1 < size)[:, None]
                ahead = np.where(live, b[:, t + 1] * back / scale[:, t + 1, None], 0.0)
                n_move += move * (f[:, t].T @ ahead)
                back = np.where(live, ahead @ move.T, 1.0)
            p = f[:, t] * back
            seen = t < size
            for k in range(4):
                n_emit[k] += np.bincount(x[seen, t], weights=p[seen, k], minlength=len(SYMBOLS))
        n_begin += p.sum(0)
    return n_begin, n_move, n_emit


def step(counts, strength: float):
    """The model of the expected counts; the table before training counts as ``strength`` lines a state."""
    begin, move, emit = (strength * start + n for start, n in zip(prior(), counts))
    return begin / begin.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)


def decode(pages: list[np.ndarray], model) -> list[np.ndarray]:
    """The most likely states of each page's lines (Viterbi)."""
    begin, move, emit = (np.log(x) for x in model)
    out = [np.zeros(0, dtype=np.int8)] * len(pages)
    for take, size, x in _padded(pages):
        rows = np.arange(len(x))
        b = np.where((x >= 0)[:, :, None], emit.T[x], 0.0)
        came = np.empty(b.shape, dtype=np.int8)
        best = begin + b[:, 0]
        for t in range(1, x.shape[1]):
            reached = best[:, :, None] + move
            live = (t < size)[:, None]
            came[:, t] = np.where(live, reached.argmax(1), np.arange(4))
            best = np.where(live, reached.max(1) + b[:, t], best)
        states = np.empty(x.shape, dtype=np.int8)
        states[:, -1] = best.argmax(1)
        for t in range(x.shape[1] - 1, 0, -1):
            states[:, t - 1] = came[rows, t, states[:, t]]
        for k, n, s in zip(take, size, states, strict=True):
            out[k] = s[:n]
    return out


def _pages(column) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.int8) for x in column.to_pylist()]


def train(lines: DataFrame, steps: int = 8, strength: float = 0.02):
    """Baum-Welch on the symbols of all pages (``symbols``, a byte a line); the table before training
    counts as ``strength`` times the number of lines for each state, so that it weighs alike at every size."""

    def run(model):
        def count(batches):
            total = np.zeros(20 + 4 * len(SYMBOLS))
            for b in batches:
                total += np.concatenate([x.ravel() for x in expected(_pages(b.column(0)), model)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "n"])

        got = lines.select("symbols").mapInArrow(count, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
        n = np.zeros(20 + 4 * len(SYMBOLS))
        for r in got:
            n[r["place"]] = r["n"]
        return n[:4], n[4:20].reshape(4, 4), n[20:].reshape(4, -1)

    model = prior()
    for _ in range(steps):
        counts = run(model)
        whole = counts[2].sum()
        if not whole:
            break
        model = step(counts, strength * whole)
    return model


def line_shares(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_lines, n_words, and for each state the share of words in its lines).

    The model is trained on all pages of the table, and all are decoded whole. Null, empty and blank
    texts have no lines and null shares. Repeated rows and null keys stay. Pages are never shuffled.
    """

    def look(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                seen = [observe(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([s.tobytes() for s, _ in seen], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in seen], pa.binary())],
                    ["key", "symbols", "sizes"],
                )

    kind = df.schema[key].dataType.simpleString()
    lines = cut(df.select(key, text).mapInArrow(look, f"key {kind}, symbols binary, sizes binary"))
    model = train(lines)

    def run(batches):
        for b in batches:
            states = decode(_pages(b.column(1)), model)
            many = np.array([len(s) for s in states], dtype=np.int64)
            row = np.repeat(np.arange(len(states)), many)
            sizes = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype="<i4").astype(float)
            flat = np.concatenate(states).astype(np.int64) if states else np.zeros(0, np.int64)
            words = np.bincount(row * 4 + flat, weights=sizes, minlength=4 * len(states)).reshape(-1, 4)
            total = words.sum(1)
            share = words / np.where(many > 0, total, 1.0)[:, None]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(many, pa.int32()), pa.array(total.astype(np.int64), pa.int32()), *(pa.array(share[:, k], mask=many == 0) for k in range(4))],
                ["key", "n_lines", "n_words", *STATES],
            )

    shares = ", ".join(f"{s} double" for s in STATES)
    return lines.mapInArrow(run, f"key {kind}, n_lines int, n_words int, {shares}").withColumnRenamed("key", key)


def stuffed_pages(df: DataFrame, key: str, text: str, most_prose: float = 0.42) -> DataFrame:
    """The pages of which less than ``most_prose`` of the words stand in lines of prose, with shares.

    Pages without lines are not flagged.
    """
    return line_shares(df, key, text).where(F.col("prose") < most_prose)
