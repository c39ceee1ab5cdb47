"""Rules as SQL predicates: from trees, from growing and pruning, and scored as ensembles."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binning import quantiles
from .core import best_first, distinct_counts, held, to_long, unused
from .encoders import FriedScale
from .models import assemble, probability
from .stats import rule_metrics


def tree_rules(debug: str, columns: list[str]) -> list[str]:
    """Conjunctions on the way to every inner node and leaf, from a tree model's text."""
    found, stack = [], []
    for line in debug.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee+]+)\)", line)
        if m:
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth] + [(depth, f"`{columns[int(m[3])]}` {m[4]} {m[5]}")]
            found.append(" AND ".join(x[1] for x in stack))
    return list(dict.fromkeys(found))


def ensemble_rules(df: DataFrame, columns: list[str], label: str, generator: str = "RandomForestClassifier", trees: int = 20, depth: int = 3, seed: int = 7) -> list[str]:
    """Distinct rules of a forest or of boosted trees."""
    x = assemble(df, columns)
    est = C.RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed) if generator == "RandomForestClassifier" else C.GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return list(dict.fromkeys(r for t in est.fit(x).trees for r in tree_rules(t.toDebugString, columns)))


def tree_sizes(trees: int | None, mean: float = 4, leaves: int | None = None, seed: int = 7) -> list[int]:
    """Leaves of each tree of a forest, ``2 + floor(e)`` with ``e`` of an exponential law of mean
    ``mean - 2``: ``trees`` of them, or as many as have ``leaves`` together."""
    draw, scale, out = np.random.default_rng(seed), max(mean - 2, 0.0), []
    while sum(out) < leaves if leaves is not None else len(out) < trees:
        out.append(2 + int(draw.exponential(scale)))
    return out


@dataclass
class _Node:
    """A node of a parsed tree: how it is reached, its children, and the rows and positives in it."""

    rule: str
    children: list[_Node] = field(default_factory=list)
    rows: int = 0
    positives: float = 0.0

    def gini(self) -> float:
        return 2 * self.positives * (self.rows - self.positives) / max(self.rows, 1)

    def gain(self) -> float | None:
        won = self.gini() - sum(c.gini() for c in self.children) if self.children else 0.0
        return won if won > 1e-12 else None


def _parsed(debug: str, columns: list[str], counts: dict[int, tuple[int, float]]) -> _Node:
    """The tree of a model's text, its leaves, from left to right, with (rows, positives)."""
    lines = iter(debug.strip().splitlines()[1:])
    leaf = 0

    def node(line: str, rule: str) -> _Node:
        nonlocal leaf
        if "Predict:" in line:
            out = _Node(rule, [], *counts.get(leaf, (0, 0.0)))
            leaf += 1
            return out
        out = _Node(rule)
        for side in (line, None):
            side = side or next(lines)
            m = re.search(r"\(feature (\d+) (<=|>) ([-\d.Ee+]+)\)", side)
            if not m:
                raise ValueError(f"not a split of a number: {side.strip()}")
            condition = f"`{columns[int(m[1])]}` {m[2]} {m[3]}"
            out.children.append(node(next(lines), f"{rule} AND {condition}" if rule else condition))
        out.rows, out.positives = (sum(getattr(c, k) for c in out.children) for k in ("rows", "positives"))
        return out

    return node(next(lines), "")


def sized_forest(df: DataFrame, columns: list[str], label: str, sizes: list[int], depth: int = 5, seed: int = 7) -> list[list[str]]:
    """For each tree of a forest the rules of its nodes but the root; the i-th tree has at most
    ``sizes[i]`` leaves.

    The forest grows to ``depth`` in one go, by variance, which for a 0/1 label splits as Gini does
    and keeps splits between leaves of one class. One aggregation counts the rows of all leaves of
    all trees; each tree is then opened best split first, by Gini over all rows, until it has its
    leaves. At most ``2 ** depth`` counts a tree come to the driver.
    """
    x = assemble(df, columns).select(F.col(label).cast("double").alias("label"), "features")
    model = R.RandomForestRegressor(numTrees=len(sizes), maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, leafCol="leaf").fit(x)
    met = model.transform(x).select("label", F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))
    counts: dict[int, dict[int, tuple[int, float]]] = {}
    for r in met.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect():
        counts.setdefault(r["tree"], {})[int(r["leaf"])] = (r["n"], r["p"] or 0.0)
    out = []
    for i, (tree, size) in enumerate(zip(model.trees, sizes, strict=True)):
        root = _parsed(tree.toDebugString, columns, counts.get(i, {}))
        out.append([c.rule for n in best_first(root, _Node.gain, lambda n: n.children, size - 1, depth) for c in n.children])
    return out


@dataclass
class Tree2Rule:
    """Rules of a tree ensemble with their metrics."""

    generator: str = "RandomForestClassifier"
    trees: int = 10
    depth: int = 3

    def fit(self, df: DataFrame, label: str, columns: list[str]) -> Tree2Rule:
        self.rules = ensemble_rules(df, columns, label, self.generator, self.trees, self.depth)
        self.metrics = rule_metrics(df.fillna(-999, columns), self.rules, label)
        return self


@dataclass
class RuleFit:
    """Rules of trees as 0/1 columns and scaled, cut linear terms under an L1 logistic regression.

    The trees of a forest have random numbers of leaves around ``tree_size`` (`tree_sizes`), not deeper
    than ``depth``, unless ``random_sizes`` is off; boosted trees all have ``depth``. There are ``trees``
    of them or, where ``max_rules`` is given, as many as have so many leaves together
    (``max_rules / tree_size`` of those of one depth). All their rules take part. Label and columns are
    kept during a fit, as forest, quantiles and regression read them again and again."""

    generator: str = "RandomForestClassifier"
    trees: int = 20
    depth: int = 5
    max_rules: int | None = None
    reg: float = 0.01
    seed: int = 7
    tree_size: int = 4
    random_sizes: bool = True

    def fit(self, df: DataFrame, label: str, columns: list[str]) -> RuleFit:
        self.columns = columns
        with held(df.select(label, *columns)) as rows:
            self._fit(rows, label, columns)
        return self

    def _fit(self, df: DataFrame, label: str, columns: list[str]) -> None:
        filled = df.fillna(-999, columns)
        if self.random_sizes and self.generator == "RandomForestClassifier":
            self.sizes = tree_sizes(self.trees, self.tree_size, self.max_rules, self.seed)
            self.rules = list(dict.fromkeys(r for rules in sized_forest(filled, columns, label, self.sizes, self.depth, self.seed) for r in rules))
        else:
            trees = self.trees if self.max_rules is None else math.ceil(self.max_rules / self.tree_size)
            self.rules = ensemble_rules(df, columns, label, self.generator, trees, self.depth, self.seed)
        self.scale = FriedScale(columns=columns).fit(filled)
        x = self._terms(filled)
        self.names = [f"__r{i}" for i in range(len(self.rules))] + columns
        self.support = [float(v or 0) for v in x.agg(*[F.avg(F.col(f"__r{i}").cast("double")) for i in range(len(self.rules))]).first()] if self.rules else []
        self.model = C.LogisticRegression(labelCol=label, regParam=self.reg, elasticNetParam=1.0).fit(assemble(x, self.names))

    def _terms(self, df: DataFrame) -> DataFrame:
        flags = {f"__r{i}": F.coalesce(F.expr(r).cast("int"), F.lit(0)) for i, r in enumerate(self.rules)}
        return self.scale.transform(df.withColumns(flags) if flags else df)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(assemble(self._terms(df.fillna(-999, self.columns)), self.names))
        return scored.withColumn("y_pred", probability(scored)).drop(*[n for n in self.names if n.startswith("__r")], "features", "rawPrediction", "probability", "prediction")

    def get_rules(self) -> list[dict]:
        """``rule, type, coef, support``, largest coefficient first."""
        coef = list(map(float, self.model.coefficients))
        rows = [{"rule": r, "type": "rule", "coef": c, "support": s} for r, c, s in zip(self.rules, coef, self.support)]
        rows += [{"rule": n, "type": "linear", "coef": c, "support": 1.0} for n, c in zip(self.columns, coef[len(self.rules) :])]
        return sorted(rows, key=lambda r: -abs(r["coef"]))


@dataclass
class SkopeRules:
    """Rules of trees that reach a precision and a recall; a row's score is the largest precision
    among the rules that hold for it."""

    precision: float = 0.5
    recall: float = 0.01
    trees: int = 20
    depth: int = 3

    def fit(self, df: DataFrame, label: str, columns: list[str]) -> SkopeRules:
        self.columns = columns
        m = rule_metrics(df.fillna(-999, columns), ensemble_rules(df, columns, label, trees=self.trees, depth=self.depth), label)
        self.rules = {r["rule"]: r["precision"] for r in m.where((F.col("class") == 1) & (F.col("precision") >= self.precision) & (F.col("recall") >= self.recall)).collect()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        hits = [F.when(F.expr(r), p).otherwise(0.0) for r, p in self.rules.items()]
        return df.fillna(-999, self.columns).withColumn("y_pred", F.greatest(F.lit(0.0), F.lit(0.0), *hits))


@dataclass
class Ripper:
    """Rules grown and pruned one after the other, then rewritten in ``rounds`` (RIPPER-k).

    Candidate conditions are ``=`` and ``!=`` on discrete columns and ``>=`` and ``<=`` at deciles on
    continuous ones; each step counts the classes under all candidates in one aggregation. A rule
    grows on a share ``1 - prune_share`` of the rows, one condition a feature, by the gain
    ``log10(p1) (d1 - d0 - least_gain)`` in precision ``d``, while ``p1`` is enough and negatives are
    left; it is pruned on the rest by (p - n) / (p + n). Rules end when too few positives are left
    or the description grows beyond the least by 64 bits. ``max_rules`` and ``max_conditions`` end
    them earlier, where given.

    In a round each rule in turn is revised: it grows on over all rows that the other rules leave. A
    replacement, grown anew on the growing share of all rows and pruned so that all rules together
    are best, takes its place if its description is shorter. What another rule says already goes.
    Counts of the final rules are of the rows that the rules before leave.
    """

    least_positives: int = 100
    max_rules: int | None = None
    max_conditions: int | None = None
    discrete: int = 20
    seed: int = 7
    prune_share: float = 0.2
    least_gain: float = 0.0
    rounds: int = 2
    rules: list[dict] = field(default_factory=list)

    def candidates(self, df: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
        """``(feature, condition)`` pairs; levels of all discrete columns come in one job, deciles of all
        continuous ones by one narrowing."""
        n = distinct_counts(df, columns)
        few, many = [c for c in columns if n[c] <= self.discrete], [c for c in columns if n[c] > self.discrete]
        levels: dict[str, list[str]] = {c: [] for c in few}
        for r in to_long(df, few).where("value is not null").distinct().collect() if few else []:  # at most ``discrete`` a column
            levels[r["feature"]].append(r["value"])
        edges, out = quantiles(df, many, [i / 10 for i in range(1, 10)]) if many else {}, []
        for c in columns:
            for v in sorted(levels.get(c, [])):
                v = v.replace("\\", "\\\\").replace("'", "\\'")
                out += [(c, f"cast(`{c}` as string) = '{v}'"), (c, f"cast(`{c}` as string) != '{v}'")]
            for q in sorted(set(edges.get(c, []))):
                out += [(c, f"`{c}` >= {q}D"), (c, f"`{c}` <= {q}D")]
        return out

    @staticmethod
    def _counts(df: DataFrame, label: str, conditions: list[str]) -> list[tuple[int, int]]:
        y = F.col(label).cast("long")
        r = df.agg(*[e for c in conditions for e in (F.sum(F.when(F.expr(c), y).otherwise(0)), F.sum(F.when(F.expr(c), 1 - y).otherwise(0)))]).first()
        return [(int(r[2 * i] or 0), int(r[2 * i + 1] or 0)) for i in range(len(conditions))]

    def _grow(self, part: DataFrame, label: str, begin: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """A rule, as (feature, condition) pairs, grown further on some rows."""
        rule = list(begin)
        if rule:
            part = part.where(F.expr(_text(rule)))
        p0, n0 = self._counts(part, label, ["true"])[0]
        while (n0 or not rule) and (self.max_conditions is None or len(rule) < self.max_conditions):
            used = {f for f, _ in rule}
            free = [(f, c) for f, c in self.conditions if f not in used]
            counts = self._counts(part, label, [c for _, c in free]) if free and p0 + n0 else []
            gain = [(math.log10(p) * (p / (p + n) - p0 / (p0 + n0) - self.least_gain) if p >= max(self.least_positives, 1) else -math.inf, c, f, p, n) for (f, c), (p, n) in zip(free, counts, strict=False)]
            best = max(gain, key=lambda g: (g[0], g[1]), default=(0,))
            if best[0] <= 0:
                break
            rule.append((best[2], best[1]))
            part, p0, n0 = part.where(F.expr(best[1])), best[3], best[4]
        return rule

    def _prune(self, part: DataFrame, label: str, rule: list[tuple[str, str]], others: list[list[tuple[str, str]]] = ()) -> list[tuple[str, str]]:
        """The beginning of a rule that has, together with other rules, the best (p - n) / (p + n)."""
        if len(rule) < 2:
            return rule
        beside = "".join(f" OR ({_text(o)})" for o in others)
        counts = self._counts(part, label, [f"({_text(rule[: i + 1])}){beside}" for i in range(len(rule))])
        if counts[-1] == (0, 0):
            return rule
        value = [(p - n) / (p + n) if p + n else -1.0 for p, n in counts]
        return rule[: 1 + max(range(len(rule)), key=lambda i: (value[i], i))]

    def description(self, rule: list[tuple[str, str]]) -> int:
        """Bits of a rule of k conditions out of all candidates, halved as some of them say the same."""
        k, n = len(rule), len(self.conditions)
        if not k or k >= n:
            return 0
        return int(0.5 * (math.log2(k) + k * math.log2(n / k) + (n - k) * math.log2(n / (n - k))))

    def fit(self, df: DataFrame, label: str, columns: list[str], id_col: str) -> Ripper:
        grow = F.pmod(F.xxhash64(F.lit(self.seed), id_col), F.lit(1000)) >= int(1000 * self.prune_share)
        self._part, *_ = unused(df, "part")
        base = df.select(id_col, label, *columns).withColumn(self._part, grow).persist()
        self.conditions = self.candidates(base, columns)
        found = self._learn(base, label)
        for _ in range(self.rounds):
            better = self._rewrite(base, label, found)
            if better == found:
                break
            found = better
        self.rules, left = [], base
        for rule in found:
            p, n = self._counts(left, label, [_text(rule)])[0]
            self.rules.append({"rule": _text(rule), "pos": p, "neg": n})
            left = left.where(~F.coalesce(F.expr(_text(rule)), F.lit(False)))
        base.unpersist()
        return self

    def _learn(self, base: DataFrame, label: str) -> list[list[tuple[str, str]]]:
        found, left, shortest = [], base, None
        while self.max_rules is None or len(found) < self.max_rules:
            grown = left.where(F.col(self._part))
            if self._counts(grown, label, ["true"])[0][0] < self.least_positives:
                break
            rule = self._grow(grown, label, [])
            if not rule:
                break
            rule = self._prune(left.where(~F.col(self._part)), label, rule)
            p, n = self._counts(left, label, [_text(rule)])[0]
            if p <= n and found:
                break
            found.append(rule)
            left = left.where(~F.coalesce(F.expr(_text(rule)), F.lit(False)))
            bits = self._bits(base, label, found)
            shortest = bits if shortest is None else min(shortest, bits)
            if bits > shortest + 64:
                found.pop()
                break
        return found

    def _rewrite(self, base: DataFrame, label: str, rules: list[list[tuple[str, str]]]) -> list[list[tuple[str, str]]]:
        """One round: every rule revised or replaced."""
        anew = self._grow(base.where(F.col(self._part)), label, []) if rules else []
        out = list(rules)
        i = 0
        while i < len(out):
            others = out[:i] + out[i + 1 :]
            covered = " OR ".join(f"({_text(o)})" for o in others) or "false"
            revised = self._grow(base.where(~F.coalesce(F.expr(covered), F.lit(False))), label, out[i])
            replaced = self._prune(base.where(~F.col(self._part)), label, anew, others)
            rule = replaced if replaced and self.description(replaced) < self.description(revised) else revised
            if any(set(rule) == set(o) for o in others):
                out.pop(i)
            else:
                out[i] = rule
                i += 1
        return out

    def _bits(self, base: DataFrame, label: str, rules: list[list[tuple[str, str]]]) -> float:
        covered = " OR ".join(f"({_text(r)})" for r in rules)
        (p, n), (all_p, all_n) = self._counts(base, label, [covered, "true"])
        entropy = lambda k, m: 0.0 if k in (0, m) or not m else m * -(k / m * math.log2(k / m) + (1 - k / m) * math.log2(1 - k / m))
        theory = sum(0.5 * (1 + len(r)) * math.log2(max(len(self.conditions), 2)) for r in rules)
        return theory + entropy(n, p + n) + entropy(all_p - p, all_p + all_n - p - n)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``y_pred``: precision of the first rule that holds, else 0."""
        out = F.lit(0.0)
        for r in reversed(self.rules):
            share = r["pos"] / (r["pos"] + r["neg"]) if r["pos"] + r["neg"] else 0.0
            out = F.when(F.coalesce(F.expr(r["rule"]), F.lit(False)), share).otherwise(out)
        return df.withColumn("y_pred", out)


def _text(rule: list[tuple[str, str]]) -> str:
    return " AND ".join(c for _, c in rule)
