import inspect

from sievework.operators import resample
from sievework.plans import catalog


def test_resampling_queries_run_at_the_operators_sizes(spark, monkeypatch):
    asked = {}
    for name in ("ratio_interval", "bleu_gap", "power"):
        whole = getattr(resample, name)

        def note(*args, whole=whole, name=name, **named):
            asked[name] = inspect.signature(whole).bind(*args, **named)
            asked[name].apply_defaults()
            return whole(*args, **named)

        monkeypatch.setattr(resample, name, note)
    for name in ("bootstrap_ci", "bleu_significance", "power_table"):
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
    got = {name: call.arguments for name, call in asked.items()}
    assert got["ratio_interval"]["rounds"] == 2000 and got["bleu_gap"]["rounds"] == 1000
    assert (got["power"]["trials"], got["power"]["rounds"], got["power"]["gaps"]) == (200, 400, [0.05, 0.10, 0.15, 0.20, 0.30])
