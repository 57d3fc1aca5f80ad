r"""Personal data: rules, high-recall candidates, and boosted trees that choose among the candidates.

Everything is a DataFrame or SQL expression over the whole text. A generator's spans come from two built-ins: the matches of
its pattern and the gaps between them, whose running lengths are the offsets in code points. The strict generators with
their checks are the base spans and always stay. The loose generators propose further, overlapping spans, also of secrets
(keys, tokens), for which there is no strict form; gradient-boosted trees choose among them. The trees learn from the
candidates of all documents (a fifth of the ids is held out for the thresholds), whose weak labels come from what the
features do not see: a base span, or a part of one of the same kind (the national part of a phone number), or a secret after a
word such as token or password. Other candidates are unlabelled, not negative: the trees' probability of a label is divided by
its mean over held-out labelled candidates of the kind (Elkan and Noto), and each kind's threshold is the lowest at which the
held-out candidates above it keep ``PRECISION`` by that measure. The trees become one CASE expression, so scoring adds no
join and no shuffle.

Defined results: null text is the empty text; no candidates, or candidates of one class, give no model and so only base
spans; a chosen span never overlaps a base span or an earlier chosen one; long runs cost linear time (possessive patterns), and n
spans of a text about n log n: offsets and neighbours come from running sums and maxima, not from comparing all spans;
other columns of documents may have any names, and those named like the two added ones are replaced (``redact`` adds none).
"""

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fold_of, fresh, written

KINDS = ("email", "ip", "card", "phone", "secret")
TREES, DEPTH, PRECISION = 8, 3, 0.9
_LOCAL = "[A-Za-z0-9._%+-]"
#: Strict patterns; an anchor at a run's start gives the leftmost match without retrying inside the run.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose patterns of the same kinds, which need the model's consent.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,3}+(?:[.,]\x20?[0-9]{1,3}+){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9]{4}(?:[\x20.,_-]?[0-9]{3,6}){2,4}",
    "phone": r"(?<![0-9+])(?:00[0-9]|\()?[0-9]{2,4}[)\x20./-]{1,2}[0-9]{3}[\x20./-]?[0-9]{3,4}(?![0-9])",
    "secret": r"(?:\G|(?<![A-Za-z0-9_+/-]))[A-Za-z0-9_+/-]{16,}+",
}
_GUARD = {"email": r"@|[(\[]at[)\]]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "secret": "[A-Za-z0-9_+/-]{16}"}
_DIGITS = "regexp_replace(c.v, '[^0-9]', '')"
_LUHN = f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + element_at(if(i % 2 = 0, array(0,2,4,6,8,1,3,5,7,9), array(0,1,2,3,4,5,6,7,8,9)), 1 + cast(substr({_DIGITS}, -i, 1) as int))) % 10 = 0"
CHECKS = {
    "email": "true",
    "ip": "forall(split(c.v, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": f"length({_DIGITS}) between 13 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
FEATURES = {
    "kind": "c.kind",
    "size": "length(c.v)",
    "digits": f"length({_DIGITS})",
    "distinct": f"size(array_distinct(split({_DIGITS}, '')))",
    "signs": "length(regexp_replace(c.v, '[A-Za-z0-9]', ''))",
    "spaces": "length(regexp_replace(c.v, '[^ ]', ''))",
    "dots": "length(regexp_replace(c.v, '[^.]', ''))",
    "letters": "length(regexp_replace(c.v, '[^A-Za-z]', ''))",
    "upper": "length(regexp_replace(c.v, '[^A-Z]', ''))",
    "runs": "size(regexp_extract_all(c.v, '[A-Za-z]+', 0))",
    "luhn": f"if(length({_DIGITS}) between 13 and 19 and {_LUHN}, 1, 0)",
    "octets": "if(c.kind = 2 and forall(split(c.v, '[^0-9]+'), p -> length(p) <= 3 and cast(concat('0', p) as int) <= 255), 1, 0)",
    "glued": "if(c.pre rlike '[A-Za-z0-9]$', 1, 0) + if(c.post rlike '^[A-Za-z0-9]', 1, 0)",
    "quoted": """if(c.pre rlike '["`]$' and c.post rlike '^["`]', 1, 0)""",
}
#: Weak label of a secret: a word before it that the features do not see.
CUE = """lower(c.pre) rlike '(token|key|secret|passw(or)?d|pwd|bearer|credential)s?[^a-z0-9]*$'"""


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "struct<kind: int, start: int, end: int, v: string, pre: string, post: string, met: boolean>"
NONE = f"cast(array() as array<{SPAN}>)"
#: Spans that are dealt with one by one before they are put to the others, and code points of a block of text.
RUN, BLOCK = 512, 1_000


def let(name: str, value: str, then: str) -> str:
    """SQL text: ``then``, in which ``name`` stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def running(array: str, join: str) -> str:
    """SQL text: an array of the joins of all elements up to each, in steps of doubled width; ``join`` is a text of earlier and x."""
    step = f"transform(a, (x, i) -> if(i >= shiftleft(1, k), {let('earlier', 'a[i - shiftleft(1, k)]', join)}, x))"
    return let("whole", array, f"aggregate(sequence(0, cast(ceil(log2(greatest(size(whole), 1))) as int)), whole, (a, k) -> {step})")


def generator(kind: str, pattern: str, text: str = "text") -> str:
    """SQL text: array of spans (kind number, start, end, value, text before, text after, false) of a pattern's matches."""
    found = f"named_struct('m', regexp_extract_all({text}, {_literal(pattern)}, 0), 'g', split({text}, {_literal(pattern)}, -1))"
    ends = running("transform(p.m, (y, j) -> length(p.g[j]) + length(y))", "earlier + x")
    span = f"named_struct('kind', {KINDS.index(kind) + 1}, 'start', e[i] - length(p.m[i]), 'end', e[i], 'v', p.m[i], 'pre', right(p.g[i], 20), 'post', left(p.g[i + 1], 1), 'met', false)"
    spans = let("e", ends, f"transform(sequence(0, size(p.m) - 1), i -> {span})")
    return f"if({text} rlike {_literal(_GUARD[kind])}, {let('p', found, f'if(size(p.m) = 0, {NONE}, {spans})')}, {NONE})"


def flagged(base: str, loose: str) -> str:
    """SQL text: of two arrays of spans, the loose ones in order as structs of c, ``same`` (a base span has its ends) and ``met`` (one overlaps it)."""
    each = lambda spans, n: f"transform({spans}, c -> named_struct('s', c.start, 'e', c.end, 'l', {n}, 'c', c))"
    begun = running("transform(q, y -> if(y.l = 0, named_struct('s', y.s, 'e', y.e, 'm', y.e), named_struct('s', -1, 'e', -1, 'm', -1)))", "named_struct('s', if(x.s >= 0, x.s, earlier.s), 'e', if(x.s >= 0, x.e, earlier.e), 'm', greatest(earlier.m, x.m))")
    ahead = running("reverse(transform(q, y -> if(y.l = 0, y.s, 2147483647)))", "least(earlier, x)")
    seen = f"transform(q, (y, j) -> named_struct('l', y.l, 'c', y.c, 'same', r.f[j].s = y.s and r.f[j].e = y.e, 'met', r.f[j].m > y.s or r.b[j] < y.e))"
    both = let("q", f"sort_array(concat({each(base, 0)}, {each(loose, 1)}))", let("r", f"named_struct('f', {begun}, 'b', reverse({ahead}))", f"filter({seen}, y -> y.l = 1)"))
    return f"if(size({loose}) = 0, cast(array() as array<struct<l: int, c: {SPAN}, same: boolean, met: boolean>>), {both})"


def candidates(docs: DataFrame, text_col: str, base: str = "_base", loose: str = "_loose") -> DataFrame:
    """Adds ``base``, the checked strict spans, and ``loose``, other proposals that do not equal one of them; ``met``: one overlaps them."""
    text, every = fresh(docs, "_text"), fresh(docs, "_every")
    strict = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    sure = [f"filter({generator(k, p, f'`{text}`')}, c -> {CHECKS[k]})" for k, p in STRICT.items()]
    more = [generator(k, p, f"`{text}`") for k, p in LOOSE.items() if k != "secret"] + [f"filter({generator(k, STRICT[k], f'`{text}`')}, c -> not ({CHECKS[k]}))" for k in ("ip", "card", "phone")]
    more.append(f"filter({generator('secret', LOOSE['secret'], f'`{text}`')}, c -> c.v rlike '[0-9]' and c.v rlike '[A-Za-z]')")
    distinct = let("w", f"sort_array(concat({', '.join(more)}))", "filter(w, (c, i) -> if(i = 0, true, c <> w[i - 1]))")
    both = strict.withColumn(base, F.expr(f"concat({', '.join(sure)})")).withColumn(every, F.expr(distinct))
    told = f"transform(filter({flagged(f'`{base}`', f'`{every}`')}, y -> not y.same), y -> named_struct({', '.join(f"'{n}', y.c.{n}" for n in ('kind', 'start', 'end', 'v', 'pre', 'post'))}, 'met', y.met))"
    return both.withColumn(loose, F.expr(told)).drop(every, text)


def _tree(lines: list[str]) -> str:
    """SQL text of a printed regression tree over a struct x of features; consumes its lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return line.split(":")[1].strip() + "D"
    number, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    yes = _tree(lines)
    lines.pop(0)
    return f"if(x.f{number} <= {bound}D, {yes}, {_tree(lines)})"


def fit(spans: DataFrame) -> tuple[str, str] | None:
    """Trained on rows of id, ``_base`` and ``_loose``: SQL text of a candidate's probability, and of the threshold of its kind."""
    near = [f"transform({flagged(f'filter(_base, c -> c.kind = {k})', f'filter(_loose, c -> c.kind = {k})')}, y -> named_struct('c', y.c, 'y', if(y.met, 1D, 0D)))" for k in range(1, len(KINDS))]
    cued = f"transform(filter(_loose, c -> c.kind = {len(KINDS)}), c -> named_struct('c', c, 'y', if({CUE}, 1D, 0D)))"
    labelled = f"concat(transform(_base, c -> named_struct('c', c, 'y', 1D)), {', '.join(near)}, {cued})"
    rows = spans.where("size(_base) + size(_loose) > 0").select("id", F.explode(F.expr(labelled)).alias("e")).select("id", "e.c", "e.y")
    data = written(rows.select("id", (fold_of("id") == 0).alias("held"), "y", *(F.expr(f"cast({e} as double)").alias(f"f{i}") for i, e in enumerate(FEATURES.values()))), "pii")
    data = VectorAssembler(inputCols=[f"f{i}" for i in range(len(FEATURES))], outputCol="features").transform(data)
    sizes = {row[0]: row[1] for row in data.where("not held").groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    model = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, seed=5).fit(data.where("not held"))
    margin = " + ".join(f"{w}D * {_tree(t.toDebugString.splitlines()[1:])}" for w, t in zip(model.treeWeights, model.trees))
    struct = ", ".join(f"'f{i}', cast({e} as double)" for i, e in enumerate(FEATURES.values()))
    probability = f"element_at(transform(array(named_struct({struct})), x -> 1 / (1 + exp(-2 * ({margin})))), 1)"
    graded = model.transform(data.where("held")).groupBy(F.col("f0").cast("int").alias("kind"), F.ceil(vector_to_array("probability")[1] * 100).alias("p"))
    bins = graded.agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("kind", F.desc("p")).collect()  # at most 101 for each kind
    return probability, "element_at(array(" + ", ".join(f"{threshold([(r['p'], r['y'], r['n']) for r in bins if r['kind'] == k])}D" for k in range(1, len(KINDS) + 1)) + "), c.kind)"


def threshold(bins: list[tuple[int, float, int]]) -> float:
    """The lowest per cent bin, from the highest down, at which all above are right often enough; bins: per cent, labelled, all. 1.01 accepts nothing."""
    mean = sum(p * y for p, y, _ in bins) / max(sum(y for _, y, _ in bins), 1e-9) / 100
    out, good, total = 1.01, 0.0, 0
    for p, _, n in bins:
        good, total = good + n * min(1.0, p / 100 / mean if mean else 0.0), total + n
        if good >= PRECISION * total:
            out = (p - 1) / 100
    return out


def find(docs: DataFrame, id_col: str, text_col: str, base: str = "_base", spans: str = "spans") -> DataFrame:
    """The given columns with ``base`` and ``spans``: all spans in order of kind, then start."""
    loose = fresh(docs, "_loose")
    found = candidates(docs, text_col, base, loose)
    model = fit(candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", "_base", "_loose"))
    if model is None:
        return found.withColumn(spans, F.col(base)).drop(loose)
    chosen = f"array_sort(filter(`{loose}`, c -> not c.met and {model[0]} >= {model[1]}), (a, b) -> case when a.start <> b.start then a.start - b.start when a.end <> b.end then b.end - a.end else a.kind - b.kind end)"
    one = "if(c.start < t.at, t, named_struct('at', c.end, 'out', concat(t.out, array(c))))"
    few = let("t", f"aggregate(slice(h, k * {RUN} + 1, {RUN}), named_struct('at', s.at, 'out', {NONE}), (t, c) -> {one})", "named_struct('at', t.at, 'out', concat(s.out, t.out))")
    kept = let("h", chosen, f"if(size(h) = 0, {NONE}, aggregate(sequence(0, (size(h) - 1) div {RUN}), named_struct('at', 0, 'out', {NONE}), (s, k) -> {few}, s -> s.out))")
    return found.withColumn(spans, F.expr(f"array_sort(concat(`{base}`, {kept}), (a, b) -> case when a.kind <> b.kind then a.kind - b.kind when a.start <> b.start then a.start - b.start else b.end - a.end end)")).drop(loose)


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, c -> concat_ws(':', element_at({names}, c.kind), c.start, c.end)), ',')"


def digest(found: DataFrame, id_col: str) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(_base, c -> c.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(STRICT, 1)]
    return found.select(id_col, *counts, F.expr(f"sha2({_joined('_base')}, 256)").alias("base_sha256"), F.expr(_joined("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same rows and columns; every span gives way to its kind in brackets. Null text stays null."""
    base, spans = fresh(docs, "_base"), fresh(docs, "_spans")
    found = find(docs, id_col, text_col, base, spans)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    by_start = f"array_sort(`{spans}`, (a, b) -> case when a.start <> b.start then a.start - b.start else b.end - a.end end)"
    at = lambda n: f"coalesce(get(b, cast(({n}) div {BLOCK} as int)), '')"  # noqa: E731  a block of text
    whole = f"concat(substr({at('f')}, f % {BLOCK} + 1), array_join(slice(b, cast(f div {BLOCK} as int) + 2, cast(c.start div {BLOCK} - f div {BLOCK} as int) - 1), ''), substr({at('c.start')}, 1, c.start % {BLOCK}))"
    cut = f"if(f div {BLOCK} = c.start div {BLOCK}, substr({at('f')}, f % {BLOCK} + 1, c.start - f), {whole})"
    piece = let("f", "if(i = 0, 0, e[i - 1])", f"if(c.start < f, '', concat({cut}, element_at({names}, c.kind)))")
    rest = let("f", "e[size(e) - 1]", f"concat(substr({at('f')}, f % {BLOCK} + 1), array_join(slice(b, cast(f div {BLOCK} as int) + 2, size(b)), ''))")
    pieces = let("e", running("transform(h, c -> c.end)", "greatest(earlier, x)"), f"concat(array_join(transform(h, (c, i) -> {piece}), ''), {rest})")
    blocks = f"regexp_extract_all(`{text_col}`, '(?s).{{1,{BLOCK}}}', 0)"
    text = f"if(size(`{spans}`) = 0, `{text_col}`, {let('h', by_start, let('b', blocks, pieces))})"
    return found.select(*(F.expr(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
