"""The whole flow's rows, against each step taken for itself in plain Python."""

from __future__ import annotations

import numpy as np
import pytest

from cuewright.operators import joins as J
from cuewright.operators import segmentation as D
from cuewright.plans import flow, registry
from cuewright.plans.views import Views
from tests.conftest import TINY


@pytest.fixture(scope="module")
def ran(spark):
    v = Views(spark, TINY)
    words = J.glossary_tag_words(J.reconcile_words(v.words, v.words_alt, bucket_ms=10_000), v.glossary).collect()
    terms = [(r["ord"], r["canonical"], r["target_spelling"], r["action"]) for r in v.glossary.orderBy("ord").collect()]
    return words, terms, [r.asDict() for r in registry.flagship(spark, TINY).collect()]


def _tracks(rows, key):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["track_id"], r[key])):
        out.setdefault(r["track_id"], []).append(r)
    return out


def test_cues_are_the_words_in_order(ran):
    words, _, cues = ran
    ours, theirs = _tracks(cues, "seg_idx"), _tracks(words, "word_idx")
    assert ours.keys() == theirs.keys() and len(cues) > 100
    for t, own in ours.items():
        w = theirs[t]
        assert [c["seg_idx"] for c in own] == list(range(len(own)))
        assert sum(c["n_words"] for c in own) == len(w)
        cuts = D.cheapest_cuts(D.cue_costs(*_arrays(w)))
        at = 0
        for k, c in enumerate(own):
            part = w[at : at + c["n_words"]]
            assert c["text"] == " ".join(r["text"] for r in part)
            assert (c["start_ms"], c["end_ms"]) == (part[0]["start_ms"], part[-1]["end_ms"])
            if cuts is not None:
                assert c["method"] == "optimal" and at == cuts[k]
            at += c["n_words"]


def _arrays(w):
    return np.array([r["start_ms"] for r in w], float), np.array([r["end_ms"] for r in w], float), [r["text"] for r in w], [r["speaker"] for r in w], [r["term_id"] for r in w]


def test_terms_and_flags(ran):
    _, terms, cues = ran
    for c in cues:
        held = [t for t in terms if t[1].lower() in c["text"].lower()]
        assert c["protected_terms"] == [t[1] for t in held]
        assert c["text_translated"] == c["text"].upper() and c["n_flags"] == len(c["qc_flags"])
        lost = [f"glossary-{'miss' if a == 'keep' else 'drift'}:{name}" for _, name, target, a in held if (name if a == "keep" else target).lower() not in c["text_translated"].lower()]
        assert [f for f in c["qc_flags"] if f.startswith("glossary-")] == lost
    assert any(c["protected_terms"] for c in cues)


def test_slots_follow_one_another(ran):
    for own in _tracks(ran[2], "seg_idx").values():
        slots = [c["end_ms"] - c["start_ms"] for c in own]
        told = [c["tts_ms"] for c in own]
        moves = sum(told) - sum(slots) > 10
        at = own[0]["start_ms"]
        for k, c in enumerate(own):
            gap = max(0, c["start_ms"] - own[k - 1]["end_ms"]) if k else 0
            new = told[k] if moves else slots[k]
            at += gap
            assert c["new_start_ms"] == pytest.approx(at if moves else c["start_ms"], abs=0.11)
            assert c["new_end_ms"] == pytest.approx(c["new_start_ms"] + new, abs=0.11)
            at += new
            drift = round(new - told[k], 1)
            assert c["drift_ms"] == pytest.approx(drift, abs=0.11)
            assert c["status"] == ("ok" if abs(c["drift_ms"]) < 50 else "warn" if abs(c["drift_ms"]) < 200 else "fail")


def test_the_flow_is_one_registered_query(spark):
    assert registry.queries()["flow_run_full"](spark, TINY).count() == flow.run_full(Views(spark, TINY)).count() > 0
