"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are known forms of secrets (keys with a known prefix, web tokens, bodies of PEM private keys, user info in
URLs, what follows ``Bearer``), values of at least ``ASSIGNED_LEAST`` characters that are assigned to a name, quoted
or not, and runs of at least ``LEAST`` letters, digits and ``+/_-``. The forest sees length, kinds of characters, how
usual their transitions are (a bigram model of the documents' words), how much of them dictionary words cover, whether
they stand in a path, and the words beside them.

It is trained from labelled findings (``context``, ``value``, ``after``, ``label``). Where a corpus has none,
``label_findings`` makes some from all documents: a value assigned to a name that speaks of a secret is one, unless
dictionary words make it up or, unquoted, it looks like code or a placeholder; other candidates are none. Known forms that
dictionary words do not make up are secrets by rule, so they are neither trained as the one nor as the other. The forest is fitted on at most ``SAMPLE`` distinct findings of each
kind (quoted and unquoted secrets, others), chosen by a hash (all where there are fewer), so its probabilities are those
of kinds of like size. Each value is also put where a neighbour stood, so that neither the value nor its place decides
alone, unless the rule makes that a secret as well.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.models import Forest
from edgelog.llm.shared import buffers, freeing, kept, prepare_workers, slices, texts_of

LEAST, ASSIGNED_LEAST = 16, 8
SAMPLE, FEW = 10_000, 30
DICTIONARY_WORDS, SHORTEST_WORD, LONGEST_WORD = 5_000, 3, 12
BESIDE = 40
REPLACEMENT = "[SECRET]"

#: Parts of names that are given to secrets.
SECRET_NAMES = "token secret password passwd pwd apikey api_key api-key access_key private_key credential auth bearer".split()

_RUN = re.compile(rf"[A-Za-z0-9+/_\-]{{{LEAST},}}={{0,2}}")
_NAME = r"[A-Za-z_][\w.\-]{0,40}[\"']?"
_GIVEN = rf"{_NAME}[ \t]{{0,3}}+[:=]{{1,2}}+>?[ \t]{{0,3}}+"
_ASSIGNED = re.compile(rf"{_GIVEN}[\"'](?P<value>[^\"'\s]{{{ASSIGNED_LEAST},}})[\"']")
_ASSIGNING = re.compile(r"([A-Za-z_][\w.\-]{0,40})[\"']?[ \t]{0,3}[:=]{1,2}>?[ \t]{0,3}[\"']?$")
_NAMED = re.compile("|".join(map(re.escape, SECRET_NAMES)), re.IGNORECASE)
#: Unquoted: no URL, nothing that assigns to a secret's name itself, and up to the next assignment of a list.
_NEXT = rf"(?![&;,?|][\"']?{_NAME}[:=])"
_BARE = re.compile(
    rf"{_GIVEN}(?![\"']|//|[A-Za-z][A-Za-z+.\-]{{0,20}}://|[\w.\-]{{0,40}}(?i:{_NAMED.pattern})[\w.\-]{{0,40}}[:=])"
    rf"(?P<value>(?:{_NEXT}\S){{{ASSIGNED_LEAST - 1},}}{_NEXT}[^\s\"',;.)\]}}>])"
)
#: Letters in one case, but for the first, that no digits or such stand beside: parts of random values are no words.
_WORD = r"^(?:[A-Z]?[a-z]+|[A-Z]+)$"
#: Bytes that stand in a word or keep what is beside them from being one; all others become blanks.
_BESIDE_WORDS = np.array([b if chr(b) in "+=" or b < 128 and chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)

_BEGIN = r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:\s|\\[nrt])*(?:[A-Z][A-Za-z\-]{1,30}: [^\n]{0,200}\n\s*)*"
#: What only secrets look like, and whether words may stand there as well (then the value must look random). First comes
#: what a text must have for that, for Arrow's expressions, which find it in a fraction of the time. Their \w and \s are ASCII.
_FORMS = [
    ("PRIVATE KEY", re.compile(_BEGIN + r"(?P<value>[A-Za-z0-9+/=](?:[A-Za-z0-9+/=\s]|\\[nrt])+)(?=-----END)"), False),
    ("PRIVATE KEY", re.compile(_BEGIN + r"(?P<value>(?:[A-Za-z0-9+/=]{16,}(?:\s|\\[nrt])*)+)"), False),  # cut off
    (
        r"(?:^|[^A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[srp]k[\-_]|AIza|npm_|hf_|ya29\."
        r"|SG\.|shp(?:at|ca|pa|ss)_|pypi-|eyJ)",
        re.compile(
            r"(?<![A-Za-z0-9])(?P<value>(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}"
            r"|glpat-[\w\-]{16,}|xox[abeoprs]-[\w\-]{10,}|[srp]k[\-_][\w\-]{16,}|AIza[\w\-]{30,}|(?:npm|hf)_[A-Za-z0-9]{20,}"
            r"|ya29\.[\w\-.]{16,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{20,}|pypi-[\w\-]{20,}"
            r"|eyJ[\w\-]{8,}\.[\w\-]{8,}(?:\.[\w\-]*)?)"
        ),
        True,
    ),
    ("://", re.compile(r"://[^\s/@:]{0,80}:(?P<value>[^\s/@]+)@"), False),
    ("://", re.compile(rf"://(?P<value>[^\s/@:]{{{LEAST},}})@"), True),
    (r"(?i:bearer)[ \t]", re.compile(rf"\b(?i:bearer)[ \t]+(?P<value>[A-Za-z0-9._~+/\-]{{{ASSIGNED_LEAST},}}=*)"), True),
]
_VALUES = [
    (rf"[:=]>?[ \t]{{0,3}}[\"'][^\"'\s]{{{ASSIGNED_LEAST}}}", _ASSIGNED),
    (rf"[:=]>?[ \t]{{0,3}}\S{{{ASSIGNED_LEAST}}}", _BARE),
]
_HINTS = [*(hint for hint, *_ in _FORMS), *(hint for hint, _ in _VALUES), rf"[A-Za-z0-9+/_\-]{{{LEAST}}}"]
_HINT = "|".join(dict.fromkeys(_HINTS))
_LETTERS = np.array(list("abcdefghijklmnopqrstuvwxyz"))
_PAIRS = np.char.add(np.repeat(_LETTERS, 26), np.tile(_LETTERS, 26))
#: The first ":" or "=" of an assignment stands at most so far behind where its name begins.
_NAME_LONGEST = 1 + 40 + 1 + 3
_SIGN = re.compile("[:=]")
_CODE = re.compile(r"\$[{(]|\$\w+$|<[^>]*>?$|\{\{|%[(s]|[A-Za-z_][\w.]*[(\[]")


def _values(form: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Places of what ``form.finditer`` finds, which is tried before ":" and "=" only."""
    at, sign = 0, _SIGN.search(text)
    while sign:
        for first in range(max(at, sign.start() - _NAME_LONGEST), sign.start()):
            if m := form.match(text, first):
                yield m.span("value")
                at = m.end()
                break
        else:
            at = sign.end()
        sign = _SIGN.search(text, at)


def candidates(text: str, may: Sequence[bool] = (True,) * len(_HINTS)) -> list[tuple[int, int, int]]:
    """First and end place of all candidates, without overlaps, in order, and 1 or 2 (words stand there, too) for a known form.

    ``may``: which of ``_HINTS`` the text has.
    """
    spans: list[tuple[int, int, int]] = []
    at: list[tuple[int, int]] = []  # the spans in order

    def take(found: Iterator[tuple[int, int]], form: int) -> None:
        for first, end in found:
            k = bisect.bisect(at, (first, end))
            if (k == 0 or at[k - 1][1] <= first) and (k == len(at) or end <= at[k][0]):
                at.insert(k, (first, end))
                spans.append((first, end, form))

    of_form, of_value, run = may[: len(_FORMS)], may[len(_FORMS) : -1], may[-1]
    for (_, form, words), has in zip(_FORMS, of_form):
        if has:
            take(((m.start("value"), m.start("value") + len(m["value"].rstrip())) for m in form.finditer(text)), 1 + words)
    for (_, form), has in zip(_VALUES, of_value):
        if has:
            take(_values(form, text), 0)
    if run:
        take((m.span() for m in _RUN.finditer(text)), 0)
    return sorted(spans)


def found_in(column: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """Place, text and candidates of every text that has some. Only texts with a hint of one become Python strings."""
    column = column.cast(pa.large_string())
    places = pc.indices_nonzero(pc.match_substring_regex(column, _HINT))
    texts = column.take(places)
    has = {hint: pc.match_substring_regex(texts, hint).to_pylist() for hint in dict.fromkeys(_HINTS)}
    for i, text, *may in zip(places.to_pylist(), texts.to_pylist(), *(has[hint] for hint in _HINTS)):
        if spans := candidates(text, may):
            yield i, text, spans


def word_counts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in lower case, and how often each occurs; a word comes again for each way to write it."""
    data, at = buffers(column)
    blanked = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(_BESIDE_WORDS[data]))
    values, n = pc.list_flatten(pc.ascii_split_whitespace(blanked)).value_counts().flatten()
    words = pc.and_(pc.match_substring_regex(values, _WORD), pc.less_equal(pc.binary_length(values), BESIDE))
    return pc.ascii_lower(values.filter(words)), n.filter(words).to_numpy()


def pair_counts(words: pa.Array, n: np.ndarray) -> np.ndarray:
    """How often each pair of letters occurs in words in lower case that occur ``n`` times, by 26 times the first letter and the second."""
    data, at = buffers(words)
    letters, inner = data.astype(np.int64) - ord("a"), np.ones(len(data), bool)
    inner[at[1:] - 1] = False  # the last letter of a word
    first = np.flatnonzero(inner)
    times = np.repeat(n, np.diff(at))[first]
    return np.bincount(26 * letters[first] + letters[first + 1], times, 676).astype(np.int64)


class Scanner:
    """Dictionary, transitions and forest."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int]):
        self.dictionary = frozenset(w for w in words if SHORTEST_WORD <= len(w) <= LONGEST_WORD)
        self.decoys = sorted(w for w in words if len(w) >= ASSIGNED_LEAST)
        singles = Counter()
        for pair, n in pairs.items():
            singles[pair[0]] += n
        self.transitions = {p: math.log((n + 0.5) / (singles[p[0]] + 20)) for p, n in pairs.items()}
        total = max(sum(pairs.values()), 1)
        mean = sum(n * self.transitions[p] for p, n in pairs.items()) / total
        any_pair = (sum(self.transitions.values()) - 6.0 * max(0, 676 - len(pairs))) / 676
        self.unusual = (mean + any_pair) / 2
        self.forest, self.known_forms = Forest(), True

    def coverage(self, value: str) -> float:
        """The share of the value that dictionary words cover, longest first."""
        low, covered, at = value.lower(), 0, 0
        while at < len(low):
            for n in range(min(LONGEST_WORD, len(low) - at), SHORTEST_WORD - 1, -1):
                if low[at : at + n] in self.dictionary:
                    covered, at = covered + n, at + n
                    break
            else:
                at += 1
        return covered / max(len(value), 1)

    def random(self, value: str) -> bool:
        """Not made of dictionary words."""
        return len(set(value)) >= 5 and self.coverage(value) < 0.6

    def odd(self, value: str) -> bool:
        """With digits, symbols that names do not have, or unusual pairs of letters; neither code nor a placeholder."""
        if _CODE.match(value):
            return False
        low = value.lower()
        pairs = [self.transitions.get(a + b, -6.0) for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
        return any(c.isdigit() or c in "!@#$%^&*+=~?" for c in value) or sum(pairs) < self.unusual * len(pairs)

    def secret_form(self, value: str, form: int) -> bool:
        """Whether a candidate of a known form is a secret by rule."""
        return self.known_forms and form > 0 and self.random(value) and (form == 1 or self.odd(value))

    def features(self, context: str, value: str, after: str) -> list[float]:
        n = max(len(value), 1)
        counts = Counter(value)
        kinds = [sum(map(test, value)) / n for test in (str.isdigit, str.isupper, str.islower)]
        low = value.lower()
        usual = [self.transitions.get(a + b, -6.0) for a, b in zip(low, low[1:])]
        shifts = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:])) / n
        assigned = _ASSIGNING.search(context)
        names = len(_NAMED.findall(context[-BESIDE:])) + len(_NAMED.findall(after))
        return [
            math.log(n),
            *kinds,
            float(all(c in "0123456789abcdefABCDEF" for c in value)),
            -sum(c / n * math.log2(c / n) for c in counts.values()),
            sum(usual) / max(len(usual), 1),
            shifts,
            self.coverage(value),
            float(value.count("/") + value.count(".") > 0 or context[-1:] in ("/", "\\", ".") or "://" in context),
            float(bool(assigned)),
            float(bool(assigned and _NAMED.search(assigned.group(1)))),
            float(names),
            float(context[-1:] in ("'", '"')),
        ]

    def probabilities(self, findings: list[tuple[str, str, str]]) -> np.ndarray:
        return self.forest.predict(np.array([self.features(*f) for f in findings]).reshape(len(findings), 14))

    def judge(self, found: list[tuple[str, int, int, int]]) -> list[float]:
        """The probability of every (text, first, end, form); 1 for known forms."""
        p = self.probabilities([_beside(*f[:3]) for f in found]).tolist()
        return [1.0 if self.secret_form(t[a:b], form) else q for (t, a, b, form), q in zip(found, p)]


def _beside(text: str, first: int, end: int) -> tuple[str, str, str]:
    return text[max(0, first - BESIDE) : first], text[first:end], text[end : end + BESIDE]


class Corpus(NamedTuple):
    """What a scanner is fitted on: counts of the most frequent words and of letter pairs, and findings."""

    words: dict[str, int]
    pairs: dict[str, int]
    findings: pd.DataFrame


def _by_rule(scanner: Scanner, context: str, value: str) -> str:
    """The self-made label: "quoted" or "bare" for a secret, a value without dictionary words that is assigned to a name
    that speaks of a secret, and "" for others."""
    name = _ASSIGNING.search(context)
    if not (name and _NAMED.search(name.group(1)) and scanner.random(value)):
        return ""
    if context[-1:] in ("'", '"'):
        return "quoted"
    return "bare" if scanner.odd(value) else ""


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def label_findings(docs: DataFrame, sample: int = SAMPLE) -> Corpus:
    """Dictionary and letter pairs (both in lower case) of all documents, and distinct findings of all documents.

    Words and pairs are counted, and findings labelled, in Spark. The driver gets ``DICTIONARY_WORDS`` words, the
    pairs of 26 letters and of each kind at most ``sample`` findings, those with the smallest hashes.
    """
    docs = texts_of(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, n = word_counts(batch.column("text"))
            pairs = pair_counts(words, n)
            some = np.flatnonzero(pairs)
            kinds = pa.array(np.repeat(["word", "pair"], [len(words), len(some)]), pa.string())
            items = pa.concat_arrays([words.cast(pa.string()), pa.array(_PAIRS[some], pa.string())])
            yield pa.RecordBatch.from_arrays([kinds, items, pa.array(np.append(n, pairs[some]))], ["kind", "item", "n"])

    counted = docs.mapInArrow(freeing(count), "kind string, item string, n bigint")
    counted = kept(counted.groupBy("kind", "item").agg(F.sum("n").alias("n")))
    words = counted.where("kind = 'word'").orderBy(F.desc("n"), "item").limit(DICTIONARY_WORDS)
    pairs = counted.where("kind = 'pair'")
    words, pairs = ({r["item"]: r["n"] for r in t.collect()} for t in (words, pairs))
    scanner = Scanner(words, pairs)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["context", "value", "after", "kind"]
        types = [pa.string()] * 4
        for batch in slices(batches):
            found = {
                _beside(text, a, b)
                for _, text, spans in found_in(batch.column("text"))
                for a, b, form in spans
                if not scanner.secret_form(text[a:b], form)
            }
            yield _batch([(*f, _by_rule(scanner, *f[:2])) for f in found], names, types)

    found = kept(docs.mapInArrow(freeing(look), "context string, value string, after string, kind string").distinct())
    columns = ["context", "value", "after"]
    kinds = (
        found.where(F.col("kind") == k).orderBy(F.xxhash64(*columns), *columns).limit(sample).select(*columns).toPandas()
        for k in ("quoted", "bare", "")
    )
    findings = pd.concat(list(kinds)).sort_values(columns).reset_index(drop=True)
    return Corpus(words, pairs, findings)


def fit(corpus: Corpus) -> Scanner:
    """A scanner; findings without a column ``label`` get one by the rule above."""
    scanner, findings = Scanner(corpus.words, corpus.pairs), corpus.findings
    rows = list(findings[["context", "value", "after"]].itertuples(index=False, name=None))
    if "label" in findings:
        labels = findings["label"].astype(float).tolist()
        scanner.known_forms = False  # the given labels alone say what a secret is
    else:
        kinds = [_by_rule(scanner, context, value) for context, value, _ in rows]
        labels = [float(k != "") for k in kinds]
        real, other = ([r for r, y in zip(rows, labels) if y == k] for k in (1, 0))
        for kind in ("quoted", "bare"):  # few secrets of a kind count as often as some
            few = [r for r, k in zip(rows[: len(kinds)], kinds) if k == kind]
            more = few * (max(0, FEW - len(few)) // len(few)) if few else []
            real, rows, labels = real + more, rows + more, labels + [1.0] * len(more)
        for (c1, v1, a1), (c0, v0, a0) in zip(real, other):
            # neither the value nor its place alone
            moved = [r for r in ((c0, v1, a0), (c1, v0, a1)) if not _by_rule(scanner, *r[:2])]
            rows += moved
            labels += [0.0] * len(moved)
        decoys = [(c, w, a) for (c, _, a), w in zip(real, scanner.decoys)]  # a word where a secret stood
        rows, labels = rows + decoys, labels + [0.0] * len(decoys)
    x = np.array([scanner.features(*r) for r in rows]).reshape(len(rows), 14)
    scanner.forest.fit(x, np.array(labels))
    return scanner


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """A row for every candidate: doc_id, start, length (code points), value, probability, secret (at least 0.5)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "value", "probability", "secret"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
        for batch in slices(batches):
            rows, found = [], []
            doc_ids = batch.column("doc_id")
            for i, text, spans in found_in(batch.column("text")):
                for a, b, form in spans:
                    rows.append((doc_ids[i].as_py(), a, b - a, text[a:b]))
                    found.append((text, a, b, form))
            if rows:
                rows = [(*r, q, q >= 0.5) for r, q in zip(rows, scanner.judge(found))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return texts_of(docs).mapInArrow(
        freeing(scanned), "doc_id bigint, start bigint, length bigint, value string, probability double, secret boolean"
    )


def redact(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; ``n_chars``, if there, follows. Null texts stay null."""

    prepare_workers(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.large_string(), from_pandas=True).fill_null("")
        found, first = [], 0
        for part in slices(iter([pa.record_batch([column], ["text"])])):
            found += [(first + i, *c) for i, _, spans in found_in(part.column("text")) for c in spans]
            first += part.num_rows
        p = scanner.judge([(texts.iloc[i], *c) for i, *c in found])
        out = texts.tolist()
        for (i, a, b, _), q in reversed(list(zip(found, p))):
            if q >= 0.5:
                out[i] = out[i][:a] + REPLACEMENT + out[i][b:]
        return pd.Series(out, dtype=object)

    text = clean(docs["text"].cast("string"))
    out = docs.withColumn("text", text)
    if "n_chars" not in docs.columns:
        return out
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
