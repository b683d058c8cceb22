"""Property tests on pure helpers (no Spark needed)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tableprep.operators.clean import standardize_names
from tableprep.operators.select import top_k
from tableprep.operators.tune import sample_trials

NAMES = st.lists(st.text(alphabet="aAb _-1!é", max_size=6), min_size=1, max_size=12)


@given(NAMES)
@settings(max_examples=200, deadline=None)
def test_standardized_names_are_unique(names):
    out = standardize_names(names)
    assert len(out) == len(names) and len(set(out)) == len(out)


@given(NAMES)
@settings(max_examples=200, deadline=None)
def test_standardize_is_idempotent(names):
    once = standardize_names(names)
    assert standardize_names(once) == once


@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False)), max_size=20),
       st.integers(min_value=0, max_value=25))
def test_top_k_size_and_order(scores, k):
    keep = top_k(scores, k)
    assert len(keep) == min(k, len(scores)) and keep == sorted(keep)
    chosen = [scores[i] for i in keep if scores[i] is not None]
    rest = [s for i, s in enumerate(scores) if i not in keep and s is not None]
    if chosen and rest:
        assert min(chosen) >= max(rest)


def test_trial_sampling_is_seeded_and_distinct():
    space = {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20]}
    a, b = sample_trials(space, 10, 42), sample_trials(space, 10, 42)
    assert a == b and len(a) == 9 and len({tuple(sorted(t.items(), key=str)) for t in a}) == 9
    assert sample_trials({}, 10) == [{}]
