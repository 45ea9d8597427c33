"""Ledger rows out of loose cells: names, types, ranges and enumerations of every column, as one projection.

A row comes as a map of texts: flat names or their aliases, or names below ``p2.`` and ``p3.``. It leaves with typed
columns, the faults for which it may not be stored (``errors``) and those that are noted (``warnings``). All rules are
expressions over the row, so a ledger of any size is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import rules

#: Names of the columns, in their order, and of their aliases.
SIGNALS = tuple("fang macd fg vix ma eod lead btc".split())
P2 = (
    "p2_p_m1 p2_p_m2 p2_p_vix p2_p_vix_bgk p2_clim p2_lo p2_hi p2_band_src p2_x_vix p2_x_har p2_x_ma p2_har_vol_20 p2_har_fc_20 p2_r p2_state p2_days_in_state p2_tone_model p2_deploy_mode p2_d_vix p2_d_har p2_d_ma p2_d_refit "
    "p2_input_missing p2_model_id p2_p_m3 p2_prob_model_id"
).split()
P2_TEXTS = "p2_band_src p2_state p2_tone_model p2_deploy_mode p2_input_missing p2_model_id p2_prob_model_id".split()
P3 = (
    "p3_sigma_ewma p3_sigma_har_fc p3_sigma_target p3_d_max p3_w_vol p3_state_mult p3_w_target p3_w_exec p3_w_reason p3_next_check p3_sigma_down p3_sigma_up p3_deploy_sizing p3_hmm_p_high p3_hmm_p20 p3_hmm_q20 p3_x_hmm p3_p_h "
    "p3_hmm_theta_id p3_hmm_gauge p3_members p3_lo p3_hi p3_band_src p3_disagree_flag p3_range_vix_lo p3_range_vix_hi p3_range_har_lo p3_range_har_hi p3_scen_bin p3_dd_from_ath p3_kill_state p3_kill_n_ep p3_kill_months p3_deploy_mode "
    "p3_effective_mode p3_alarms p3_registry_sha p3_sizing_sha p3_input_missing p3_run_id"
).split()
P3_TEXTS = "p3_w_reason p3_next_check p3_hmm_theta_id p3_hmm_gauge p3_members p3_band_src p3_scen_bin p3_kill_state p3_deploy_mode p3_effective_mode p3_alarms p3_registry_sha p3_sizing_sha p3_input_missing p3_run_id".split()
ALIASES = {
    "p2_prob": "prob_dd5_20", "p2_p": "prob_dd5_20", "p2_har_fc": "p2_har_fc_20", "p2_har_vol": "p2_har_vol_20", "p2_days": "p2_days_in_state", "p2_missing": "p2_input_missing", "p3_sigma": "p3_sigma_ewma", "p3_sigma_har": "p3_sigma_har_fc",
    "p3_har_fc": "p3_sigma_har_fc", "p3_mult": "p3_state_mult", "p3_reason": "p3_w_reason", "p3_w": "p3_w_exec", "p3_missing": "p3_input_missing", "p3_dd": "p3_dd_from_ath", "p3_theta_id": "p3_hmm_theta_id", "p3_gauge": "p3_hmm_gauge",
    "p3_p_high": "p3_hmm_p_high",
}
#: Chances, whole numbers, switches, events; sets that are closed, and sets that others may widen.
CHANCES = "prob_dd5_20 p2_p_m1 p2_p_m2 p2_p_m3 p2_p_vix p2_p_vix_bgk p2_clim p2_lo p2_hi p3_hmm_p_high p3_hmm_p20 p3_hmm_q20 p3_p_h p3_lo p3_hi".split()
WHOLE = "p2_days_in_state p3_kill_n_ep p3_kill_months".split()
SWITCHES, EVENTS = ("p3_deploy_sizing",), ("p3_disagree_flag",)
CLOSED = {"p2_state": "normal caution reduce".split(), "p3_w_reason": "init weekly escalation hold input_missing info_only".split(), "p3_kill_state": "not_started not_due provisional validated info_only manual_kill".split()}
OPEN = {
    "p2_deploy_mode": ("info_only", "tones"), "p2_band_src": ("param", "calib"), "p2_tone_model": ("M1", "M3"), "p3_deploy_mode": ("info_only", "tones"), "p3_effective_mode": ("info_only", "tones"), "p3_band_src": ("members", "p2"),
}
OUTCOMES = "y_sign_20 y_sign_60 y_dd5_20 fwd_ret_20 fwd_ret_60 fwd_maxdd_20 rv20_realized ret20_in_vix80 ret20_in_har80 rule_ret_20 bh_ret_20 p3_rule_dd".split()
MEMBERS = ("p2", "M1", "H")
NUMBERS = ["score_d", "score_w", "score_m", "spy_close", "vix_close", "prob_dd5_20", *(c for c in P2 if c not in P2_TEXTS), *(c for c in P3 if c not in P3_TEXTS and c not in SWITCHES and c not in EVENTS)]
TEXTS = ["overall_d", "overall_w", "overall_m", "run_id", *P2_TEXTS, *(c for c in P3_TEXTS if c not in ("p3_members", "p3_alarms"))]
YES, NO = ("true", "t", "yes", "y", "1", "1.0"), ("false", "f", "no", "n", "0", "0.0")
CLOSE = 1e-12
PHASES = ("p2_", "p2.", "p3_", "p3.")


def keys_of(column: str) -> list[str]:
    """Where a column's value may stand, in the order of precedence: by name, by alias, below its phase."""
    names = [column, *(a for a, c in ALIASES.items() if c == column)]
    return names + [f"{n[:2]}.{n[3:]}" for n in names if n[:3] in ("p2_", "p3_")]


def phase(key: Column) -> Column:
    """How a name begins that belongs to a phase: p2_, p2., p3_ or p3."""
    return F.substring(key, 1, 3)


def spoken(cells: str) -> Column:
    """The cells that say something, trimmed."""
    return F.map_filter(F.transform_values(cells, lambda _, v: F.trim(v)), lambda _, v: (v != "") & (F.lower(v) != "nan"))


def cell(*keys: str) -> Column:
    """The first of these cells that says something; names of a phase are sought among its own."""
    return F.coalesce(*(F.try_element_at(f"_{k[:2]}" if k[:3] in PHASES else "_other", F.lit(k)) for k in keys))


def listed(faults: dict[str, Column]) -> Column:
    """The names of what holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in faults.items())))


def members(text: Column) -> tuple[Column, Column]:
    """Members' chances in the registry's order, then by name; and whether the text isn't such an object."""
    found = F.from_json(text, "map<string,string>")
    number = lambda v: v.try_cast("double")
    fine = lambda v: v.isNull() | (number(v).isNotNull() & number(v).between(0.0, 1.0))
    bad = text.isNotNull() & (found.isNull() | ~F.coalesce(F.forall(F.map_values(found), fine), F.lit(True)))
    names = F.map_keys(found)
    order = F.concat(F.filter(F.array(*map(F.lit, MEMBERS)), lambda m: F.array_contains(names, m)), F.sort_array(F.filter(names, lambda m: ~m.isin(*MEMBERS))))
    one = lambda m: F.concat(F.lit('"'), m, F.lit('": '), F.coalesce(number(F.try_element_at(found, m)).cast("string"), F.lit("null")))
    return F.when(~bad, F.concat(F.lit("{"), F.array_join(F.transform(order, one), ", "), F.lit("}"))), bad


def normalised(rows: DataFrame) -> DataFrame:
    """rows (any key columns, and cells) with asof, variant, states, tone, all columns of the ledger, errors and warnings."""
    kept = [c for c in rows.columns if c != "cells"]
    raw = {c: cell(*keys_of(c)) for c in (*NUMBERS, *TEXTS, *SWITCHES, *EVENTS, "p3_members", "p3_alarms")}
    d = rows.withColumn("_said", spoken("cells"))
    d = d.withColumns({
        "_p2": F.map_filter("_said", lambda k, _: phase(k).isin(*PHASES[:2])), "_p3": F.map_filter("_said", lambda k, _: phase(k).isin(*PHASES[2:])), "_other": F.map_filter("_said", lambda k, _: ~phase(k).isin(*PHASES)),
    })
    names = F.map_keys("cells")
    known = {k for c in raw for k in keys_of(c)} | set(OUTCOMES)
    odd = F.sort_array(F.filter(names, lambda k: phase(k).isin(*PHASES) & ~k.isin(*sorted(known))))
    # lambdas beside the cells keep Spark from fusing them into one method, which would be too long to be compiled
    has = {"_has_p2": F.exists(names, lambda k: phase(k).isin(*PHASES[:2])), "_has_p3": F.exists(names, lambda k: phase(k).isin(*PHASES[2:]))}
    d = d.withColumns({"_odd": odd, **has, "asof": F.substring(cell("asof"), 1, 10).try_cast("date"), "_variant": cell("variant"), "tone": cell("tone"), **{f"state_{k}": cell(f"state_{k}", f"states.{k}") for k in SIGNALS}, **{f"_{c}": v for c, v in raw.items()}})
    truth = {c: F.when(F.lower(f"_{c}").isin(*YES), 1.0).when(F.lower(f"_{c}").isin(*NO), 0.0) for c in (*SWITCHES, *EVENTS)}
    text, bad_members = members(F.col("_p3_members"))
    codes = F.array_join(F.sort_array(F.array_distinct(F.filter(F.transform(F.split("_p3_alarms", ","), lambda x: F.trim(x)), lambda x: x != ""))), ",")
    typed = {
        "variant": F.coalesce("_variant", F.lit("faithful")), **{c: F.col(f"_{c}").try_cast("double") for c in NUMBERS}, **{c: F.col(f"_{c}") for c in TEXTS}, **{c: truth[c] for c in SWITCHES},
        **{c: F.when(truth[c] == 1.0, 1.0) for c in EVENTS}, "p3_members": text, "p3_alarms": F.nullif(codes, F.lit("")),
    }
    d = d.withColumns({"_bad_members": bad_members, **typed})
    c, p = F.col, F.col("prob_dd5_20")
    errors = {
        "asof": c("asof").isNull(), "tone": c("tone").isNull() | ~c("tone").isin(*rules.TONES),
        **{f"not_number:{n}": c(f"_{n}").isNotNull() & c(n).isNull() for n in NUMBERS}, **{f"chance:{n}": ~c(n).between(0.0, 1.0) for n in CHANCES}, **{f"whole:{n}": (c(n) < 0) | (c(n) != F.floor(n)) for n in WHOLE},
        **{f"set:{n}": ~c(n).isin(*v) for n, v in CLOSED.items()}, **{f"truth:{n}": c(f"_{n}").isNotNull() & truth[n].isNull() for n in truth}, "members": c("_bad_members"), "band:p3": c("p3_lo") > c("p3_hi") + CLOSE,
    }
    outside = lambda x: (c(f"{x}_lo") > p + CLOSE) | (c(f"{x}_hi") < p - CLOSE)
    warnings = {
        "variant": c("_variant").isNull(), **{f"state:{k}": c(f"state_{k}").isNull() for k in SIGNALS}, **{f"set:{n}": ~c(n).isin(*v) for n, v in OPEN.items()}, "outside:p2": F.coalesce(outside("p2"), F.lit(False)), "outside:p3": outside("p3"),
        "no_reason:p2": c("_has_p2") & p.isNull() & c("p2_input_missing").isNull(), "no_reason:p3": c("_has_p3") & c("p3_w_exec").isNull() & c("p3_w_reason").isNull() & c("p3_input_missing").isNull(),
        "weight_of_info_only": c("p3_w_exec").isNotNull() & (c("p3_w_reason") == "info_only"), **{f"outcome:{n}": cell(n).isNotNull() for n in OUTCOMES},
    }
    out = ["asof", "variant", *(f"state_{k}" for k in SIGNALS), "tone", *NUMBERS, *TEXTS, *SWITCHES, *EVENTS, "p3_members", "p3_alarms"]
    return d.select(*kept, *out, listed(errors).alias("errors"), F.concat(listed(warnings), F.transform("_odd", lambda k: F.concat(F.lit("unknown:"), k))).alias("warnings"))
