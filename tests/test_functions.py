import math

import numpy as np
import pytest

from hedera.functions import dist
from hedera.functions.errors import ConvergenceError, EngineError, LinearAlgebraError, SpecificationError, error_boundary
from hedera.functions.kernels import automatic_bandwidth, canonical_kernel, kernel_type, kernel_weight, max_lag
from hedera.functions.linalg import equilibrated_gram_inverse, fix_psd, ordered_rank, wald
from hedera.functions.spec import Factor, FixedEffect, absorb_factor_variable, data_requirements, fe, fv, interaction, merge_requirements, normalize_absorb, required_columns


def test_distributions_against_tables():
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
    assert dist.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_ppf(0.95, 10) == pytest.approx(18.30703805, abs=1e-7)
    assert dist.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.f_ppf(0.95, 3, 20) == pytest.approx(3.098391, abs=1e-5)
    assert dist.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert math.isnan(dist.t_sf(1.0, 0))


def test_kernels():
    assert kernel_weight(1, 3) == pytest.approx(2 / 3) and kernel_weight(3, 3) == 0 and kernel_weight(0, 3, "qs") == 1
    assert canonical_kernel("Newey_West") == "bartlett" and kernel_type("daniell") == "spectral"
    assert automatic_bandwidth(100) == 5 and max_lag(10, 3.7, "parzen") == 3 and max_lag(10, 2, "qs", 9) == 9
    with pytest.raises(SpecificationError):
        kernel_weight(1, 2, "nope")


def test_rank_and_inverse():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 3))
    x = np.c_[x, x[:, 0] + 2 * x[:, 1], np.zeros(50), 5 * x[:, 2]]
    keep, gone = ordered_rank(x.T @ x)
    assert keep == [0, 1, 2] and gone[3] == ("linear_combination", (0, 1)) and gone[4][0] == "absorbed_or_zero" and gone[5] == ("duplicate_or_scaled", (2,))
    inverse, rank = equilibrated_gram_inverse(x[:, :3].T @ x[:, :3])
    assert rank == 3 and np.allclose(inverse, np.linalg.inv(x[:, :3].T @ x[:, :3]))
    assert np.linalg.eigvalsh(fix_psd(np.diag([1.0, -1.0]))).min() >= 0
    assert wald(np.array([2.0]), np.array([[4.0]])) == pytest.approx(1.0) and math.isnan(wald(np.ones(2), np.ones((2, 2))))


def test_factor_language():
    e = fv("i(a, base=last)##c(z) + (i(b) + x)#c(w)")
    assert e.terms == ((Factor("a", "last"),), ("z",), (Factor("a", "last"), "z"), (Factor("b"), "w"), ("x", "w"))
    assert fv("i('my col')").terms == ((Factor("my col"),),)
    for bad in ("i(a", "i(a,nope=1)", "a ++ b", "", "c(x, base=last)"):
        with pytest.raises(SpecificationError):
            fv(bad)


def test_absorbed_terms():
    assert absorb_factor_variable(fv("i(a)#i(b)")) == [FixedEffect(("a", "b"))]
    assert absorb_factor_variable(fv("i(a)##c(t)")) == [FixedEffect(("a",), ("t",), True)]
    assert absorb_factor_variable(fv("i(a)#c(t)")) == [FixedEffect(("a",), ("t",), False)]
    assert absorb_factor_variable(fv("i(a)##i(b)")) == [FixedEffect(("a", "b"))]
    with pytest.raises(SpecificationError):
        absorb_factor_variable(fv("i(a, base=first)"))
    got = normalize_absorb(["f", ("a", "b"), {"group": "g", "slopes": ["s"], "intercept": False}, interaction("c", "d"), fe("e", "t")])
    assert [t.label for t in got] == ["f", "a#b", "g#c.s", "c#d", "e##c.t"]


def test_columns_by_role():
    got = data_requirements(y="y", x=["x", "i(f)"], absorb=["f", ("a", "b")], cluster=["a"], weights="w")
    assert [(r.column, r.roles) for r in got] == [("y", ("outcome",)), ("x", ("regressor",)), ("f", ("factor", "fixed_effect")), ("a", ("fixed_effect", "cluster")), ("b", ("fixed_effect",)), ("w", ("weight",))]
    assert required_columns(y="y", x="z") == ["y", "z"]
    assert len(merge_requirements(got, data_requirements(y="x"))) == 6


def test_error_boundary():
    @error_boundary("here")
    def f(e):
        raise e

    with pytest.raises(LinearAlgebraError) as info:
        f(np.linalg.LinAlgError("singular"))
    assert info.value.to_dict()["stage"] == "here"
    with pytest.raises(ConvergenceError):
        f(ConvergenceError("no"))
    with pytest.raises(KeyError):
        f(KeyError("x"))
    assert issubclass(ConvergenceError, EngineError)
