"""Free text mapped to the closest entry of a reference list, or to none.

A prefix-filter set-similarity join. Labels and names are cleaned of amounts, units and words of
preparation, folded (case, accents, scanning errors) and turned into sets of padded letter pairs.
Pairs are ordered by how rare they are among all names; only the rare prefix of a label is looked up
in the index of the names' prefixes; a length filter, a positional filter and the exact Jaccard
similarity follow. What is left is checked word by word, since one letter may part two foods: every
word must be a written form of one word of the name. Of the names that pass, the best is kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

#: The least Jaccard similarity of two sets of letter pairs.
LEAST = 0.3
#: Names of one block of the reference list, which goes to all executors; longer lists take several blocks.
BLOCK = 50_000
#: The most labels to one task of the look-up.
FORMS = 100_000
NONE = "none"

#: Amounts, units, and words of preparation or quality, that don't change what a label means: a list tuned on such labels.
WITHOUT_MEANING = frozenset(
    """
    a an the of some little few good best fine fresh ripe cold hot warm dry dried washed roasted boiled baked chopped finely
    pounded well ground grated sliced peeled raw cooked crushed minced strained clean cleaned large small whole half quarter
    pound pounds ounce ounces oz lb lbs cup cups spoon spoons spoonful handful pinch quart pint measure quantity piece pieces
    drop drops dash glass jug one two three four five six seven eight nine ten i ii iii iv v vi vii viii ix x see note notes
    and with de del la le
    """.split()
)

_NOTE = re.compile(r"\([^)]*\)?|\[[^\]]*\]?")
_CUT = re.compile(r"(?<=[a-z])[~.](s?)(?![a-z])")
_GLUE = re.compile(r"[_\-]+")
_OTHER = re.compile(r"[^a-z ]+")
_DIGITS = str.maketrans("015", "ols")


def fold(text: str) -> str:
    """Lower case without accents; digits inside words as the letters they look like."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(w.translate(_DIGITS) if any("a" <= c <= "z" for c in w) else w for w in t.split())


def distance(a: str, b: str, most: int) -> int:
    """Edits from a to b, a swap of neighbours counting once; more than ``most`` gives most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


def _allowed(word: str) -> int:
    return 0 if len(word) < 3 else 1 if len(word) < 7 else 2


def _letters(word: str) -> str:
    """u and v, which old print mixes up, made one."""
    return word.replace("v", "u")


_SPELLED = frozenset(_letters(w) for w in WITHOUT_MEANING)
_LONG = [w for w in sorted(_SPELLED) if len(w) >= 5]


@lru_cache(200_000)
def _meaningless(word: str) -> bool:
    """Whether a word, or its plural, or for longer ones a spelling one edit away, means nothing."""
    if len(word) < 2 or word in _SPELLED or word.endswith("s") and word[:-1] in _SPELLED:
        return True
    return len(word) >= 4 and any(abs(len(word) - len(x)) <= 1 and distance(word, x, 1) <= 1 for x in _LONG)


def words_of(label: str) -> list[str]:
    """The words of a label that mean something, folded; cut-off ones without their mark."""
    t = _NOTE.sub(" ", fold(label))
    t = _OTHER.sub(" ", _CUT.sub(" ", _GLUE.sub(" ", t)))
    return [w for w in map(_letters, t.split()) if not _meaningless(w)]


def pairs_of(words: list[str]) -> set[str]:
    """The letter pairs of the words, their edges included."""
    return {f"^{w}$"[i : i + 2] for w in words for i in range(len(w) + 1)}


@lru_cache(200_000)
def written(word: str, meant: str) -> int:
    """How far ``word`` is from being ``meant`` in writing; -1 if it isn't. A cut-off word costs 1."""
    most = _allowed(meant)
    d = distance(word, meant, most)
    if d > most and "rn" in meant:  # scans read it as m
        d = distance(word, meant.replace("rn", "m"), most)
    if d <= most:
        return d
    if len(word) >= 4 and len(meant) - len(word) >= 2:
        d = min(distance(word, meant[:n], 1) for n in (len(word) - 1, len(word), len(word) + 1))
        if d <= (len(word) >= 5):
            return 1 + d
    if len(word) >= 5 and word.endswith("s") and len(meant) - len(word) >= 1 and meant.startswith(word[:-1]):
        return 1
    return -1


def apart(words: list[str], name: list[str]) -> int:
    """How far a label's words are from a name's: the sum over a pairing of all words of both, or over
    the words written as one; -1 if some word has no partner."""
    best = -1
    if len(words) == len(name):
        best = _pairing(words, name)
    if len(words) != len(name) and min(len(words), len(name)) == 1:
        a = "".join(words)
        for b in {"".join(name), "".join(reversed(name))}:
            most = 1 if len(b) < 8 else 2
            d = distance(a, b, most)
            if d <= most and (best < 0 or d + 1 < best):
                best = d + 1
    return best


_NEVER = 10**6


def _pairing(words: list[str], name: list[str]) -> int:
    """The least sum of edits over all ways to pair the words with the name's, -1 if there is none: an
    assignment found word by word along cheapest alternating paths, however many words there are."""
    cost = [[d if (d := written(w, meant)) >= 0 else _NEVER for meant in name] for w in words]
    if any(min(row) == _NEVER for row in cost):
        return -1
    n = len(words)
    partner = [-1] * n  # of each of the name's words
    gain_w, gain_n = [0] * n, [0] * n
    for start in range(n):
        far, via, done = [4 * _NEVER * n] * n, [-1] * n, [False] * n
        w, last = start, -1
        while w >= 0:
            for k in range(n):
                if not done[k]:
                    d = cost[w][k] - gain_w[w] - gain_n[k] + (far[last] if last >= 0 else 0)
                    if d < far[k]:
                        far[k], via[k] = d, last
            last = min((k for k in range(n) if not done[k]), key=far.__getitem__)
            done[last] = True
            w = partner[last]
        end = far[last]
        gain_w[start] += end
        for k in range(n):
            if done[k] and k != last:
                gain_w[partner[k]] += end - far[k]
                gain_n[k] -= end - far[k]
        while last >= 0:
            before = via[last]
            partner[last] = partner[before] if before >= 0 else start
            last = before
    total = sum(cost[partner[k]][k] for k in range(n))
    return total if total < _NEVER else -1


class NameIndex:
    """The prefixes of all names of a block, by letter pair."""

    def __init__(self, names: list[tuple[str, str]], least: float = LEAST):
        self.least = least
        self.names = [(entry, words_of(name)) for entry, name in names]
        self.names = [(e, w, pairs_of(w)) for e, w in self.names if w]
        self.count = Counter(p for _, _, s in self.names for p in s)
        self.index: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, _, s) in enumerate(self.names):
            for i, p in enumerate(self.prefix(s)):
                self.index[p].append((k, i))

    def order(self, s: set[str]) -> list[str]:
        return sorted(s, key=lambda p: (self.count.get(p, 0), p))

    def prefix(self, s: set[str]) -> list[str]:
        return self.order(s)[: len(s) - math.ceil(self.least * len(s) - 1e-9) + 1]

    def similar(self, s: set[str]) -> list[tuple[float, int]]:
        """(Jaccard, name) of every name at least as similar as wanted."""
        n, t = len(s), self.least
        tried, out = set(), []
        for i, p in enumerate(self.prefix(s)):
            for k, j in self.index.get(p, ()):
                if k in tried:
                    continue
                tried.add(k)
                m = len(self.names[k][2])
                if m < t * n - 1e-9 or m > n / t + 1e-9:
                    continue
                if 1 + min(n - i - 1, m - j - 1) < t / (1 + t) * (n + m) - 1e-9:
                    continue
                both = len(s & self.names[k][2])
                if both >= t * (n + m - both) - 1e-9:
                    out.append((both / (n + m - both), k))
        return out

    def best(self, label: str) -> tuple[int, float, str] | None:
        """(edits, -Jaccard, entry) of the best name that passes the check of the words, or nothing."""
        return self.best_of(words_of(label))

    def best_of(self, words: list[str]) -> tuple[int, float, str] | None:
        found = None
        if words:
            for jaccard, k in self.similar(pairs_of(words)):
                d = apart(words, self.names[k][1])
                if d >= 0 and (found is None or (d, -jaccard, self.names[k][0]) < found):
                    found = (d, -jaccard, self.names[k][0])
        return found


def map_to_list(df: DataFrame, key: str, label: str, names: DataFrame, entry: str, name: str, least: float = LEAST) -> DataFrame:
    """(key, entry, edits, similarity): the entry that each row's label means, or 'none' with nulls.

    ``names`` has one row per name of an entry. Rows with a null or blank label have no row. Repeats
    of a row give one row; a key with several labels is mapped by its smallest. Null keys, names and
    entries are dropped. An empty list maps all to 'none'. Labels of the same words are looked up once;
    names go out in blocks of a fixed size, one after the other, each block over all distinct labels.
    """
    rows = (
        df.where(F.col(key).isNotNull() & (F.regexp_replace(label, r"\s+", "") != ""))
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(label).alias("label"))
    )
    kind = rows.schema["key"].dataType.simpleString()

    def clean(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"].array, "form": [" ".join(words_of(x)) for x in pdf["label"]]})

    meant = cut(rows.mapInPandas(clean, f"key {kind}, form string"))
    # labels of the same words are looked up once; small rows, much work, so they go to all tasks whatever their size
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-meant.count() // FORMS))
    forms = meant.where("form <> ''").select("form").distinct().repartition(tasks, "form")
    known = cut(names.select(F.col(entry).cast("string").alias("e"), F.col(name).alias("n")).where("e is not null and n is not null").distinct())
    blocks = max(1, -(-known.count() // BLOCK))
    if blocks > 1:
        forms = cut(forms)

    def mapper(block: list[tuple[str, str]]):
        def run(batches):
            index = NameIndex(block, least)
            for pdf in batches:
                got = [index.best_of(x.split(" ")) or (None, None, None) for x in pdf["form"]]
                out = pd.DataFrame(got, columns=["edits", "unlike", "entry"]).astype({"edits": "Int32", "unlike": "Float64"})
                out.insert(0, "form", pdf["form"].array)
                yield out[out["entry"].notna()]

        return run

    found = None
    for b in range(blocks):  # one block at a time, here and on the executors
        block = known.where(F.pmod(F.xxhash64("e", "n"), F.lit(blocks)) == b).collect()
        part = forms.mapInPandas(mapper(sorted((r["e"], r["n"]) for r in block)), "form string, edits int, unlike double, entry string")
        if blocks > 1:
            part = cut(part)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("form").agg(F.min(F.struct("edits", "unlike", "entry")).alias("x")).select("form", "x.*")
    # most labels share few forms: the forms' side is never the hot one
    return meant.join(found, "form", "left").select(
        F.col("key").alias(key), F.coalesce("entry", F.lit(NONE)).alias(entry), "edits", (-F.col("unlike")).alias("similarity")
    )
