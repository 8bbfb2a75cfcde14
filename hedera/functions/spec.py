"""Specifications: absorbed fixed effects, factor variables and their small language, omissions, settings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from itertools import product

from .errors import SpecificationError

MOST_WAYS, MOST_TERMS = 8, 4096


# ------------------------------------------------------------------------------------------------------ absorbed terms


@dataclass(frozen=True)
class Interaction:
    """A categorical interaction: one level for each combination that occurs."""

    parts: tuple[str, ...]
    name: str | None = None


@dataclass(frozen=True)
class FixedEffect:
    """An absorbed term: a group, slope variables with a coefficient for each level, and whether levels have intercepts."""

    group: tuple[str, ...]
    slopes: tuple[str, ...] = ()
    intercept: bool = True
    name: str | None = None

    def __post_init__(self):
        if not self.group or not (self.intercept or self.slopes):
            raise SpecificationError("a fixed effect needs a group, and an intercept or a slope", code="specification.fixed_effect")

    @property
    def label(self) -> str:
        base = "#".join(self.group)
        if not self.slopes:
            return self.name or base
        return self.name or base + ("##" if self.intercept else "#") + "+".join(f"c.{s}" for s in self.slopes)


def interaction(*parts: str, name: str | None = None) -> Interaction:
    return Interaction(tuple(parts), name)


def fe(group, *slopes: str, intercept: bool = True, name: str | None = None) -> FixedEffect:
    parts = group.parts if isinstance(group, Interaction) else (group,) if isinstance(group, str) else tuple(group)
    return FixedEffect(parts, tuple(slopes), intercept, name)


def normalize_absorb(absorb) -> list[FixedEffect]:
    """Absorbed terms from names, tuples of names, dicts, Interaction, FixedEffect or fv() expressions, alone or in a list."""
    if absorb is None:
        return []
    if isinstance(absorb, (str, dict, Interaction, FixedEffect, FactorExpression)):
        absorb = [absorb]
    out: list[FixedEffect] = []
    for a in absorb:
        if isinstance(a, str) and re.search(r"[#()+]", a):
            a = fv(a)
        if isinstance(a, FactorExpression):
            out += absorb_factor_variable(a)
        elif isinstance(a, FixedEffect):
            out.append(a)
        elif isinstance(a, str):
            out.append(FixedEffect((a,)))
        elif isinstance(a, Interaction):
            out.append(FixedEffect(a.parts, name=a.name))
        elif isinstance(a, dict):
            group = a["group"]
            slopes = a.get("slopes") or ()
            out.append(fe(group, *((slopes,) if isinstance(slopes, str) else slopes), intercept=a.get("intercept", True), name=a.get("name")))
        elif isinstance(a, tuple) and a and all(isinstance(x, str) for x in a):
            out.append(FixedEffect(a))
        else:
            raise SpecificationError(f"not a fixed effect: {a!r}", code="specification.fixed_effect")
    return out


# ---------------------------------------------------------------------------------------------------------- regressors


@dataclass(frozen=True)
class Factor:
    """A categorical regressor. base: None or 'first', 'last', 'freq', 'none' or a level."""

    variable: str
    base: object = None
    drop_base: bool = True
    name: str | None = None

    @property
    def root(self) -> str:
        return self.name or self.variable


@dataclass(frozen=True)
class RegressorInteraction:
    """A product of factors and numeric columns."""

    parts: tuple
    name: str | None = None


@dataclass(frozen=True)
class FactorExpression:
    """Terms of an expression, each a tuple of Factor and column names."""

    terms: tuple[tuple, ...]
    text: str = ""


def factor(variable: str, *, base=None, drop_base: bool = True, name: str | None = None) -> Factor:
    return Factor(variable, base, drop_base, name)


def reg_interaction(*parts, name: str | None = None) -> RegressorInteraction:
    return RegressorInteraction(tuple(parts), name)


_TOKEN = re.compile(r"""\s*(?:(##|[#+(),=])|"([^"]*)"|'([^']*)'|([^\s#+(),="']+))""")


class _Reader:
    """Recursive descent over sums of full crosses (##) of crosses (#) of atoms: i(x), c(z), names and parentheses."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SpecificationError(f"cannot read {text!r} at {text[at:]!r}", code="specification.factor_expression")
            quoted = m[2] if m[2] is not None else m[3]
            self.tokens.append(("op", m[1]) if m[1] else ("quoted", quoted) if quoted is not None else ("name", m[4]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in values

    def take(self, value: str) -> None:
        if not self.peek(value):
            raise SpecificationError(f"expected {value!r}", code="specification.factor_expression")
        self.at += 1

    def word(self) -> tuple[str, str]:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "op":
            raise SpecificationError("expected a name", code="specification.factor_expression")
        self.at += 1
        return self.tokens[self.at - 1]

    def sum(self) -> list[tuple]:
        terms = self.full()
        while self.peek("+"):
            self.at += 1
            terms += self.full()
        return terms

    def full(self) -> list[tuple]:
        sides = [self.cross()]
        while self.peek("##"):
            self.at += 1
            sides.append(self.cross())
        if len(sides) == 1:
            return sides[0]
        terms: list[tuple] = []
        for size in range(1, len(sides) + 1):
            terms += [sum(c, ()) for pick in _subsets(len(sides), size) for c in product(*(sides[i] for i in pick))]
        return terms

    def cross(self) -> list[tuple]:
        terms = self.atom()
        while self.peek("#"):
            self.at += 1
            terms = [a + b for a, b in product(terms, self.atom())]
        return terms

    def atom(self) -> list[tuple]:
        if self.peek("("):
            self.at += 1
            terms = self.sum()
            self.take(")")
            return terms
        kind, name = self.word()
        if kind == "name" and name in ("i", "c") and self.peek("("):
            self.at += 1
            variable, base = self.word()[1], None
            if self.peek(","):
                self.at += 1
                if name == "c" or self.word()[1] != "base":
                    raise SpecificationError("i() takes base=", code="specification.factor_expression")
                self.take("=")
                base = self.word()[1]
            self.take(")")
            return [(Factor(variable, base),)] if name == "i" else [(variable,)]
        return [(name,)]


def _subsets(n: int, size: int) -> Iterable[tuple[int, ...]]:
    from itertools import combinations

    return combinations(range(n), size)


def fv(expression: str) -> FactorExpression:
    """Reads an expression such as 'i(a)##c(z) + i(b, base=last)#i(d)'; main effects stand before interactions."""
    r = _Reader(expression)
    terms = r.sum()
    if r.at != len(r.tokens):
        raise SpecificationError(f"cannot read the end of {expression!r}", code="specification.factor_expression")
    if len(terms) > MOST_TERMS or any(len(t) > MOST_WAYS for t in terms):
        raise SpecificationError(f"more than {MOST_TERMS} terms or {MOST_WAYS} ways", code="specification.factor_expression")
    terms = list(dict.fromkeys(terms))
    return FactorExpression(tuple(sorted(terms, key=len)), expression)


def absorb_factor_variable(e: FactorExpression) -> list[FixedEffect]:
    """i(a)#i(b) is a joint effect, i(a)#c(t) a slope; terms that finer ones contain go."""
    found: dict[tuple[str, ...], dict] = {}
    for term in e.terms:
        if any(isinstance(p, Factor) and p.base is not None for p in term):
            raise SpecificationError("base= has no meaning in absorbed terms", code="specification.absorb")
        group = tuple(sorted({p.variable for p in term if isinstance(p, Factor)}))
        slopes = [p for p in term if isinstance(p, str)]
        if len(slopes) > 1:
            raise SpecificationError("an absorbed term has one continuous variable at most", code="specification.absorb")
        if not group:
            continue  # a common slope is no absorbed term; with ## the levels' slopes contain it
        own = found.setdefault(group, {"slopes": [], "intercept": False})
        if slopes and slopes[0] not in own["slopes"]:
            own["slopes"].append(slopes[0])
        own["intercept"] |= not slopes
    out = []
    for group, own in found.items():
        finer = [o for g, o in found.items() if set(group) < set(g)]
        slopes = tuple(s for s in own["slopes"] if not any(s in o["slopes"] for o in finer))
        intercept = own["intercept"] and not any(o["intercept"] for o in finer)
        if slopes or intercept:
            out.append(FixedEffect(group, slopes, intercept))
    if not out:
        raise SpecificationError("nothing to absorb", code="specification.absorb")
    return out


def terms_of(x) -> list[tuple]:
    """Regressors as terms: tuples of Factor and column names."""
    if x is None:
        return []
    if isinstance(x, (str, Factor, RegressorInteraction, FactorExpression)):
        x = [x]
    out: list[tuple] = []
    for v in x:
        if isinstance(v, str) and re.search(r"[#()]", v):
            v = fv(v)
        if isinstance(v, FactorExpression):
            out += v.terms
        elif isinstance(v, RegressorInteraction):
            out.append(tuple(v.parts))
        elif isinstance(v, (str, Factor)):
            out.append((v,))
        else:
            raise SpecificationError(f"not a regressor: {v!r}", code="specification.regressor")
    return out


# ----------------------------------------------------------------------------------------------------------- omissions


@dataclass(frozen=True)
class Omit:
    """What the user leaves out: a column by its expanded name, a whole term, or a level of a factor (of one term)."""

    kind: str
    what: object
    level: object = None
    term: object = None


def omit_column(name: str) -> Omit:
    return Omit("column", name)


def omit_term(term: str) -> Omit:
    return Omit("term", term)


def omit_level(component: str, level, *, term: str | None = None) -> Omit:
    return Omit("level", component, level, term)


# ------------------------------------------------------------------------------------------------------------- columns


@dataclass(frozen=True)
class Requirement:
    column: str
    roles: tuple[str, ...]


def data_requirements(**roles) -> list[Requirement]:
    """Columns that a specification reads, each with its roles, in order of first use.

    Keywords: y, x, exog, endog, instruments, absorb, cluster, weights, offset, exposure, time, panel, group, individual.
    """
    found: dict[str, list[str]] = {}

    def add(name, role: str) -> None:
        if name is not None and role not in found.setdefault(name, []):
            found[name].append(role)

    names = {"y": "outcome", "weights": "weight", "offset": "offset", "exposure": "exposure", "time": "time", "panel": "panel", "group": "group", "individual": "individual"}
    for key, value in roles.items():
        if key in names:
            for v in [value] if isinstance(value, str) or value is None else value:
                add(v, names[key])
        elif key == "cluster":
            for v in [value] if isinstance(value, str) else value or []:
                for part in v if isinstance(v, tuple) else v.parts if isinstance(v, Interaction) else (v,):
                    add(part, "cluster")
        elif key == "absorb":
            for f in normalize_absorb(value):
                for g in f.group:
                    add(g, "fixed_effect")
                for s in f.slopes:
                    add(s, "slope")
        elif key in ("x", "exog", "endog", "instruments"):
            role = {"x": "regressor", "exog": "regressor", "endog": "endogenous", "instruments": "instrument"}[key]
            for term in terms_of(value):
                for p in term:
                    add(p.variable if isinstance(p, Factor) else p, "factor" if isinstance(p, Factor) else role)
        else:
            raise SpecificationError(f"unknown role {key!r}", code="specification.role")
    return [Requirement(c, tuple(r)) for c, r in found.items()]


def merge_requirements(*many: Sequence[Requirement]) -> list[Requirement]:
    found: dict[str, list[str]] = {}
    for r in (r for rs in many for r in rs):
        own = found.setdefault(r.column, [])
        own += [x for x in r.roles if x not in own]
    return [Requirement(c, tuple(r)) for c, r in found.items()]


def required_columns(**roles) -> list[str]:
    return [r.column for r in data_requirements(**roles)]


#: Roles of columns that only name groups.
IDENTIFIERS = frozenset(("fixed_effect", "cluster", "group", "individual", "factor"))


# ------------------------------------------------------------------------------------------------------------ settings


@dataclass(frozen=True)
class HDFEConfig:
    """solver: auto, driver (level space on the driver) or map (alternating projections on the cluster)."""

    solver: str = "auto"
    tolerance: float = 1e-8
    max_iter: int = 16_000
    dof_method: str = "pairwise"
    canonicalize: bool = True
    driver_cells: int = 5_000_000

    def __post_init__(self):
        if self.solver not in ("auto", "driver", "map") or self.dof_method not in ("exact", "pairwise", "firstpair", "none"):
            raise SpecificationError("unknown solver or dof method", code="specification.config")


@dataclass(frozen=True)
class InferenceConfig:
    vce: str | None = None
    confidence_level: float = 0.95
    diagnostics: str = "publication"


@dataclass(frozen=True)
class PPMLConfig:
    tolerance: float = 1e-8
    max_iter: int = 1_000
    separation: tuple[str, ...] = ("fe", "simplex", "relu")
    mu_tol: float = 1e-6
    relu_tol: float = 1e-4
    relu_zero_tol: float = 1e-8
    relu_max_iter: int = 100
    standardize: bool = True
    dof_method: str = "pairwise"
    max_step_halving: int = 2
    step_halving_memory: float = 0.9
    hdfe: HDFEConfig = field(default_factory=lambda: HDFEConfig(tolerance=1e-10))

    def but(self, **changes) -> PPMLConfig:
        return replace(self, **changes)
