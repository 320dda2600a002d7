"""The finding record every rule returns, the rule registry and the run over all rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions.review import DISCIPLINE_CONFIDENCE, lookup, needs_license
from redliner.operators.validate import union_all

FINDING_COLUMNS = [
    "finding_id", "project_id", "sheet_id", "discipline", "rule_id", "rule_version", "severity",
    "requires_licensed_review", "evidence_id", "citation", "draft_comment_text", "confidence",
    "needs_attention", "advisory_licensed_note",
]


def finding(
    rule_id: str | Column,
    discipline: str,
    severity: str | Column,
    text: Column,
    evidence: Column,
    confidence: Column | float = 1.0,
    citation: str | Column | None = None,
    sheet: str = "sheet_id",
    version: str = "1.0.0",
    licensed_note: bool = False,
) -> Column:
    """Finding struct of one row.

    The licensed flag is membership in the critical-path set and nothing else;
    a rule that asks for a licensed look without being in the set sets the
    advisory note. Confidence is that of the weakest input.
    """
    rule = rule_id if isinstance(rule_id, Column) else F.lit(rule_id)
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    cite = citation if isinstance(citation, Column) else F.lit(citation).cast("string")
    floor = DISCIPLINE_CONFIDENCE.get(discipline, 0.0)
    return F.struct(
        F.sha2(F.concat_ws("\u001f", rule, F.col("project_id").cast("string"), F.col(sheet).cast("string"), evidence.cast("string")), 256).alias("finding_id"),
        F.col("project_id").alias("project_id"),
        F.col(sheet).cast("string").alias("sheet_id"),
        F.lit(discipline).alias("discipline"),
        rule.alias("rule_id"),
        F.lit(version).alias("rule_version"),
        sev.alias("severity"),
        needs_license(rule).alias("requires_licensed_review"),
        evidence.cast("string").alias("evidence_id"),
        cite.alias("citation"),
        text.alias("draft_comment_text"),
        conf.cast("double").alias("confidence"),
        (conf < floor).alias("needs_attention"),
        F.lit(licensed_note).alias("advisory_licensed_note"),
    )


def emit(df: DataFrame, *args, **kwargs) -> DataFrame:
    """Every row of ``df`` as a finding."""
    return df.select(finding(*args, **kwargs).alias("f")).select("f.*")


Rule = Callable[[Mapping[str, DataFrame]], DataFrame]
RowCheck = Callable[[], tuple[Column, Column]]


@dataclass
class RuleBook:
    """Versioned rules over a context of named frames.

    Row checks decide one row of one frame; all checks of a frame share one scan
    of it. Frame rules take the whole context and may join or aggregate.
    """

    rules: dict[str, tuple[Rule, tuple[str, ...]]] = field(default_factory=dict)
    checks: dict[str, dict[str, RowCheck]] = field(default_factory=dict)

    def rule(self, rule_id: str, *needs: str):
        """Register a frame rule and the frames it reads."""

        def wrap(fn: Rule) -> Rule:
            if rule_id in self.rules:
                raise ValueError(f"rule {rule_id} exists")
            self.rules[rule_id] = (fn, needs)
            return fn

        return wrap

    def check(self, rule_id: str, frame: str, discipline: str, severity: str | Column, **options):
        """Register a row check: a function returning (broken, comment text, evidence id)."""

        def wrap(fn: Callable[[], tuple[Column, Column, Column]]):
            def build() -> tuple[Column, Column]:
                broken, text, evidence = fn()
                opts = {k: v() if callable(v) else v for k, v in options.items()}
                sev = severity() if callable(severity) else severity
                return broken, finding(rule_id, discipline, sev, text, evidence, **opts)

            self.checks.setdefault(frame, {})[rule_id] = build
            return fn

        return wrap

    def ids(self) -> list[str]:
        return [*self.rules, *[r for per in self.checks.values() for r in per]]

    def run(self, context: Mapping[str, DataFrame], only: Sequence[str] | None = None) -> DataFrame:
        """Findings of every rule whose frames the context holds."""
        chosen = [
            fn(context)
            for rule_id, (fn, needs) in self.rules.items()
            if (only is None or rule_id in only) and all(n in context for n in needs)
        ]
        for frame, per in self.checks.items():
            built = [b() for rule_id, b in per.items() if only is None or rule_id in only]
            if built and frame in context:
                hits = F.array_compact(F.array(*[F.when(broken, f) for broken, f in built]))
                chosen.append(context[frame].select(F.explode(hits).alias("f")).select("f.*"))
        if not chosen:
            raise ValueError("no rule can run on this context")
        return union_all(chosen)


@dataclass(frozen=True)
class Extractor:
    """A versioned extractor: a function from pages to rows with provenance columns."""

    name: str
    version: str
    run: Callable[..., DataFrame]
    columns: tuple[str, ...]

    def __call__(self, *frames: DataFrame) -> DataFrame:
        out = self.run(*frames).withColumn("extractor_version", F.lit(f"{self.name}:{self.version}"))
        missing = set(self.columns) - set(out.columns)
        if missing:
            raise ValueError(f"{self.name} lacks {sorted(missing)}")
        return out


def undecided(cases: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work list: cases no rule decided, with the role that should look at them."""
    from redliner.functions.review import escalation_role

    rest = cases.join(findings.select(*keys).distinct(), list(keys), "left_anti")
    return rest.withColumn("role", escalation_role(F.col("confidence"), F.col("rule_id")))


def gate_confidence(measures: DataFrame) -> DataFrame:
    """Flag measures below the minimum of their type."""
    from redliner.functions.review import MIN_CONFIDENCE

    floor = lookup(MIN_CONFIDENCE, F.col("type"), 0.0)
    return measures.withColumn("minimum", floor).withColumn("needs_attention", F.col("confidence") < floor)
