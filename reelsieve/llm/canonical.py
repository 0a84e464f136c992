"""Free-entered values to a canonical list: n-gram index, weighted cosine, threshold and margin.

Distinct values are normalised to one or more spellings. An inverted index of character 2- and 3-grams
over the list's names retrieves every name that shares a gram with a spelling; the weighted cosine (rare
grams weigh more) scores them all at once, and every name at or above the threshold is a candidate, with
no limit to their number. An exact check follows: a candidate stays if the edits between the spelling and
the name are few for the name's length. Of what stays the highest cosine is accepted; of cosines close to
it the one with fewer edits, and where these are equal it must be a margin above the next, else none is.

The list never comes to the driver. It is cut into parts and the values into slices; names, gram weights
and values of a part and slice meet in one task, which builds the part's index and then lets the values
pass. Gram weights come from the whole list, so the parts don't show in the result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsieve.session import cut

#: Words that surround a name and say nothing about which, and values that name none.
NOISE = "ad ag by brand business co company corp gmbh group inc industry limited llc logo ltd official plc retail sa sector the tm"
PLACEHOLDERS = "n/a na nan nil no none not null other tbd tba unclear undefined unknown unsure various misc missing empty not applicable not available not given not shown not specified not visible no brand no logo not known keine unbekannt"
#: Digits and signs typed for letters that look like them.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a"}
THRESHOLD = 0.15
MARGIN = 0.02
#: Cosines this near to the highest are told apart by edits: a swap of letters costs many grams, but one edit.
CLOSE = 0.15
#: Names of one part of the list, which a task indexes at once.
PART_NAMES = 100_000
#: Values of a slice, at least; and at least as many as a part has names, so that copies of names don't outnumber them.
SLICE_VALUES = 1_000
#: Scores made at once.
SCORES = 4_000_000
_NOISE = frozenset(NOISE.split())
_BLANK = frozenset("".join(re.findall("[a-z]+", p)) for p in [*PLACEHOLDERS.split(), "not applicable", "not available", "not given", "not shown", "not specified", "not visible", "no brand", "no logo", "not known"])


def words_of(text: str) -> list[str]:
    """Lower-case words without accents and signs; ``/``, ``,`` and ``&`` between words are ``and``."""
    text = re.sub("[™®©]", " ", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    text = re.sub(r"(?<=\w)\s*[/&]\s*(?=\w)|(?<=\w)\s*,\s+(?=\w)|\s\+\s", " and ", text.casefold())
    if re.search(r"[^\W\d_]", text):
        text = "".join(LOOKALIKES.get(c, c) for c in text)
    return re.findall(r"[^\W_]+", text)


def _stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def spellings(text: str) -> list[str]:
    """The value's spellings to try, the plainest first: without surrounding words, and with its parts
    in the other order (``B and A``, ``B A``). Words are joined, so spaces never count."""
    words = words_of(text)
    if len(words) > 2 and all(len(w) == 1 for w in words):
        words = ["".join(words)]  # letters spaced out
    own = [w for w in words if w not in _NOISE] or words
    while len(own) > 1 and own[-1] == "and":
        own = own[:-1]
    while len(own) > 1 and own[0] == "and":
        own = own[1:]
    forms = [own]
    if len(own) > 1:
        # a surrounding word that was itself mistyped
        if any(edits(own[-1], n, 2) <= (1 if len(n) < 6 else 2) for n in _NOISE if len(n) > 4):
            forms.append(own[:-1])
        for base in list(forms):
            n = len(base)
            forms += [base[i:] + base[:i] for i in range(1, n)] if n <= 8 else []
            forms += [base[i + 1 :] + [base[i]] + base[:i] for i in range(1, n - 1)] if n <= 8 else []
    out = ["".join(map(_stem, f)) for f in forms]
    return list(dict.fromkeys(x for x in out if x))


def grams(form: str) -> list[str]:
    s = f"^{form}$"
    return [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2)]


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two texts; ``most + 1`` beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prior, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row = [most + 1] * (len(b) + 1)
        row[0] = i
        for j in range(low, high + 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if prior is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, prior[j - 2] + 1)
            row[j] = v
        if min(row) > most:
            return most + 1
        prior, last = last, row
    return min(last[-1], most + 1)


def allowed(form: str) -> int:
    """Edits a name of this length may be away: 1 for the shortest, a quarter of long ones."""
    n = len(form)
    return 1 if n < 8 else 2 if n < 14 else max(3, n // 4)


class Index:
    """Inverted index of one part of a list: gram -> (names, weights), of unit length for each name."""

    def __init__(self, forms: Sequence[tuple[str, int]], weight: dict[str, float], rare: float):
        self.forms = sorted(set(forms))
        self.weight, self.rare = weight, rare
        self.exact: dict[str, set[int]] = defaultdict(set)
        names: dict[str, list[int]] = defaultdict(list)
        shares: dict[str, list[float]] = defaultdict(list)
        for k, (form, entry) in enumerate(self.forms):
            self.exact[form].add(entry)
            for g, w in self._vector(form).items():
                names[g].append(k)
                shares[g].append(w)
        self.place = {g: i for i, g in enumerate(names)}
        size = np.array([len(x) for x in names.values()], np.int64)
        self.begin, self.size = np.cumsum(size) - size, size
        self.names = np.array([k for x in names.values() for k in x], np.int64)
        self.shares = np.array([w for x in shares.values() for w in x])

    def _vector(self, form: str) -> dict[str, float]:
        v: dict[str, float] = defaultdict(float)
        for g in grams(form):
            v[g] += self.weight.get(g, self.rare)
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    def candidates(self, spelled: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(names, cosines) of each spelling's names at or above the threshold, the highest first."""
        step = max(1, SCORES // max(1, len(self.forms)))
        for b in range(0, len(spelled), step):
            part = spelled[b : b + step]
            row, gram, share = [], [], []
            for i, form in enumerate(part):
                for g, w in self._vector(form).items():
                    if (at := self.place.get(g)) is not None:
                        row.append(i)
                        gram.append(at)
                        share.append(w)
            row, gram, share = np.array(row, np.int64), np.array(gram, np.int64), np.array(share)
            n = self.size[gram] if len(gram) else np.zeros(0, np.int64)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[gram] if len(gram) else n, n)
            flat = np.bincount(np.repeat(row, n) * len(self.forms) + self.names[at], weights=np.repeat(share, n) * self.shares[at], minlength=len(part) * len(self.forms))
            score = flat.reshape(len(part), -1)
            for s in score:
                k = np.flatnonzero(s >= THRESHOLD)
                yield (k := k[np.lexsort((k, -s[k]))]), s[k]

    def match(self, values: Sequence[str]) -> list[list[tuple[int, float, int]]]:
        """The best two entries of each value, as (entry, cosine, edits), in the order of ``decide``.

        A value that is a placeholder or has no letter has none.
        """
        out: list[list[tuple[int, float, int]]] = [[] for _ in values]
        other: dict[int, list[str]] = {}
        plain: list[tuple[int, str]] = []
        for i, value in enumerate(values):
            tried = spellings(value)
            if not tried or all(x in _BLANK for x in tried) or not any(c.isalpha() for c in value):
                continue
            if len(own := self.exact.get(tried[0], ())) == 1:
                out[i] = [(next(iter(own)), 1.0, 0)]
            else:
                plain.append((i, tried[0]))
                other[i] = tried[1:]
        found: dict[int, dict[int, tuple[float, int]]] = defaultdict(dict)
        self._checked(plain, found)
        # other orders of the words, and without surrounding ones, where the plain spelling is more than an edit away
        self._checked([(i, form) for i, forms in other.items() if not any(d <= 1 for _, d in found[i].values()) for form in forms], found)
        for i, best in found.items():
            out[i] = decide([(e, s, d) for e, (s, d) in best.items()])
        return out

    def _checked(self, tried: list[tuple[int, str]], found: dict[int, dict[int, tuple[float, int]]]) -> None:
        """Add each value's candidates that pass the exact check: entry -> (cosine, edits)."""
        for (i, form), (names, scores) in zip(tried, self.candidates([f for _, f in tried])):
            best = found[i]
            for k, s in zip(names.tolist(), scores.tolist()):
                name, entry = self.forms[k]
                most = allowed(name)
                if abs(len(name) - len(form)) > most or (entry in best and best[entry][0] >= s):
                    continue
                if sum(x > s + CLOSE for x, _ in best.values()) >= 2:
                    break  # two entries are too far above it
                d = edits(form, name, most)
                if d <= most:
                    best[entry] = (s, d)


def decide(found: list[tuple[int, float, int]]) -> list[tuple[int, float, int]]:
    """The accepted entry first, then the one that comes nearest to it; all of (entry, cosine, edits).

    The highest cosine is first; of those close to it the one with the fewest edits.
    """
    if not found:
        return []
    top = max(s for _, s, _ in found)
    return sorted(found, key=lambda x: (x[1] < top - CLOSE, x[2] if x[1] >= top - CLOSE else 0, -x[1], x[0]))[:2]


def accepted(found: list[tuple[int, float, int]]) -> tuple[int, float, int]:
    """(entry or 0, cosine, edits): none where two entries are within the margin and as many edits away."""
    if not found:
        return 0, 0.0, -1
    (entry, s, d), rest = found[0], found[1:]
    tied = any(abs(s - x) < MARGIN and y == d for _, x, y in rest)
    return (0 if tied else entry), s, d


def _plain(name: str) -> str:
    words = words_of(name)
    return "".join(map(_stem, [w for w in words if w not in _NOISE] or words))


def _forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_plain(x) for x in b.column(2).to_pylist()], pa.string())], names=["list_name", "entry_id", "form"])


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(n, g) for n, form in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for g in set(grams(form))]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([g for _, g in found], pa.string())], names=["list_name", "gram"])


#: What a row of a task is, in the order in which they come: a gram's weight, a name, a value.
GRAM, NAME, VALUE = 0, 1, 2
MEETING = "part int, slice int, list_name string, kind int, text string, entry_id bigint, weight double"
FOUND = "list_name string, value string, found array<struct<entry_id: bigint, score: double, edits: int>>"


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best two entries of each value within a part; rows come by part, slice, list and kind."""
    at, index = None, None
    weight: dict[str, float] = {}
    names: list[tuple[str, int]] = []
    kinds = pa.list_(pa.struct([("entry_id", pa.int64()), ("score", pa.float64()), ("edits", pa.int32())]))
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        keys = list(zip(*columns[:4]))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if keys[a][:3] != at:
                at, index, weight, names = keys[a][:3], None, {}, []
            kind, text = keys[a][3], columns[4][a:b]
            if kind == GRAM:
                weight.update(zip(text, columns[6][a:b]))
            elif kind == NAME:
                names += zip(text, columns[5][a:b])
            else:
                index = index or Index(names, weight, weight.get("", 0.0))
                found = [[{"entry_id": e, "score": s, "edits": d} for e, s, d in x] for x in index.match(text)] if names else [[]] * len(text)
                yield pa.RecordBatch.from_arrays([pa.array(columns[2][a:b], pa.string()), pa.array(text, pa.string()), pa.array(found, kinds)], names=["list_name", "value", "found"])


def _decided(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [accepted(decide([(x["entry_id"], x["score"], x["edits"]) for part in v for x in part])) for v in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in got], pa.int64()), pa.array([round(x[1], 6) for x in got], pa.float64()), pa.array([x[2] for x in got], pa.int32())], names=["list_name", "value", "entry_id", "score", "edits"])


def map_values(values: DataFrame, entries: DataFrame, part_names: int = PART_NAMES, slice_values: int = SLICE_VALUES) -> DataFrame:
    """(list_name, value, entry_id, score, edits) of each distinct (list_name, value).

    ``values``: list_name, value. ``entries``: entry_id, list_name, entry_name, also_known_as. A value
    that is null or only white space has no row; one that names no entry, is a placeholder or has no
    letter gets 0. Values of a list without entries get 0. Equal values are mapped once, however
    often they were typed. Other columns aren't read. The driver sees three counts.
    """
    blank = F.regexp_replace("value", r"(?U)\s+", "") == ""
    distinct = cut(values.select("list_name", "value").where(F.col("value").isNotNull() & F.col("list_name").isNotNull() & ~blank).distinct())
    names = entries.select("list_name", F.col("entry_id").cast("bigint").alias("entry_id"), F.explode(F.concat(F.array("entry_name"), F.coalesce("also_known_as", F.array().cast("array<string>")))).alias("name")).where("name IS NOT NULL AND entry_id IS NOT NULL AND list_name IS NOT NULL")
    forms = cut(names.mapInArrow(_forms, "list_name string, entry_id bigint, form string").where("form <> ''").distinct())
    n_values, n_forms = distinct.count(), forms.count()
    parts = max(1, -(-n_forms // part_names))
    slices = max(1, -(-n_values // max(slice_values, n_forms // parts)))

    count = forms.groupBy("list_name").agg(F.count_distinct("form").alias("n"))
    gram = forms.select("list_name", "form").distinct().mapInArrow(_grams, "list_name string, gram string").groupBy("list_name", "gram").agg(F.count("*").alias("c"))
    weight = gram.join(count, "list_name").select("list_name", F.col("gram").alias("text"), F.log(1 + F.col("n") / F.col("c")).alias("weight"))
    # the weight of a gram that no name has
    weight = weight.unionAll(count.select("list_name", F.lit(""), F.log(1 + F.col("n"))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = {"long": F.lit(None).cast("bigint"), "double": F.lit(None).cast("double")}
    part = F.pmod(F.xxhash64("list_name", "form"), F.lit(parts)).cast("int")
    slice_ = F.pmod(F.xxhash64("list_name", "value"), F.lit(slices)).cast("int")
    rows = weight.withColumn("part", each(parts)).select("part", each(slices).alias("slice"), "list_name", F.lit(GRAM).alias("kind"), "text", none["long"].alias("entry_id"), "weight")
    rows = rows.unionAll(forms.withColumn("part", part).select("part", each(slices).alias("slice"), "list_name", F.lit(NAME), F.col("form"), "entry_id", none["double"]))
    rows = rows.unionAll(distinct.select(each(parts).alias("part"), slice_.alias("slice"), "list_name", F.lit(VALUE), F.col("value"), none["long"], none["double"]))
    met = rows.repartition(parts * slices, F.xxhash64(F.lit(17), "part", "slice")).sortWithinPartitions("part", "slice", "list_name", "kind").mapInArrow(_meet, FOUND)
    all_ = met.groupBy("list_name", "value").agg(F.collect_list("found").alias("found")) if parts > 1 else met.select("list_name", "value", F.array("found").alias("found"))
    return all_.mapInArrow(_decided, "list_name string, value string, entry_id bigint, score double, edits int")
