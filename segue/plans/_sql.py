"""SQL fragments used by the SQL twins (independent of the Column library)."""

from segue.functions.vocab import KEY_CODES


def clip(x, lo=0.0, hi=1.0):
    return f"greatest({lo}::double, least({hi}::double, {x}))"


def tempo(a, b):
    d = f"least(abs({a}-{b})/greatest({a},1.0::double), abs(2*{a}-{b})/greatest(2*{a},1.0::double), abs({a}-2*{b})/greatest(2*{b},1.0::double))"
    return f"""(case when {a}<=0 or {b}<=0 then 0.5::double when {d}<=0.02::double then 1.0::double when {d}<=0.05::double then 0.9::double
 when {d}<=0.08::double then 0.9::double-({d}-0.05::double)*(0.4::double/0.03::double)
 when {d}<=0.15::double then 0.5::double-({d}-0.08::double)*(0.4::double/0.07::double)
 else greatest(0.05::double, 0.1::double-({d}-0.15::double)*0.5::double) end)"""


def hour(c):
    return f"(case when length({c})<2 then 0 else cast(left({c}, length({c})-1) as integer) end)"


def wheel(a, b):
    same = f"right({a},1)=right({b},1)"
    h = f"least(abs({hour(a)}-{hour(b)}), 12-abs({hour(a)}-{hour(b)}))"
    return f"""(case when {hour(a)}=0 or {hour(b)}=0 then 6 when {h}=0 and {same} then 0 when {h}=0 then 1 when {h}=1 and {same} then 1
 when {h}=1 then 2 when {h}=2 then 3 when {h}=3 then 4 else least({h},6) end)"""


def key(a, b):
    return f"""(case when {a}='' or {b}='' then 0.5::double else (case {wheel(a, b)} when 0 then 1.0::double when 1 then 0.9::double
 when 2 then 0.7::double when 3 then 0.5::double when 4 then 0.3::double when 5 then 0.15::double else 0.05::double end) end)"""


def energy(a, b):
    d = f"abs({a}-{b})"
    return f"""(case when {a}<=0 and {b}<=0 then 0.8::double when {d}<0.1::double then 1.0::double when {d}<0.2::double then 0.85::double
 when {d}<0.3::double then 0.7::double when {d}<0.5::double then 0.5::double else greatest(0.2::double, 1.0::double-{d}) end)"""


def spectral(a, b):
    r = f"(least({a},{b})/greatest({a},{b}))"
    return f"""(case when {a}<=0 or {b}<=0 then 0.5::double when {r}>0.85::double then 1.0::double when {r}>0.7::double then 0.8::double
 when {r}>0.5::double then 0.6::double else greatest(0.2::double,{r}) end)"""


def acoustic(a="a_", b="b_"):
    """Unrounded acoustic score over prefixed columns."""
    return f"""((0.4::double*{tempo(a + 'bpm', b + 'bpm')} + 0.3::double*{key(a + 'camelot', b + 'camelot')}
 + 0.2::double*{energy(a + 'mean_energy', b + 'mean_energy')} + 0.1::double*{spectral(a + 'spectral_centroid', b + 'spectral_centroid')})/1.0::double)"""


def snap(x, n=3):
    return f"round(({x}) + 1e-9, {n})"


def overall(a="a_", b="b_"):
    return snap(acoustic(a, b))


def case_of(expr, table, otherwise="null"):
    return f"(case {expr} " + " ".join(f"when {k!r} then {v!r}" if isinstance(v, str) else f"when {k!r} then {float(v)}::double" for k, v in table.items()) + f" else {otherwise} end)"


def gap(a="a_bpm", b="b_bpm"):
    return f"(abs({a}-{b})/greatest({a},1.0::double))"


def type_mod(kind, d, ov, al, bl):
    return f"""(case {kind} when 'beatmatched_blend' then (case when {d}>0.08::double then 0.3::double when {d}>0.05::double then 0.7::double else 1.0::double end)*(case when {ov}<4 then 0.5::double else 1.0::double end)
 when 'phrase_cut' then (case when {d}<0.02::double then 0.8::double else 1.0::double end)
 when 'crossfade' then (case when {d}>0.10::double then 0.6::double else 1.0::double end)
 when 'bass_swap' then (case when {d}>0.05::double then 0.5::double else 1.0::double end)*(case when {al}>0.4::double and {bl}>0.4::double then 0.7::double else 1.0::double end)
 when 'filter_sweep' then (case when {ov}<3 then 0.6::double else 1.0::double end)
 when 'echo_out' then (case when {d}>0.08::double then 1.1::double else 1.0::double end)
 when 'loop_blend' then (case when {d}>0.06::double then 0.5::double else 1.0::double end)
 else 1.0::double end)"""


KEYS_VALUES = ", ".join(f"('{k}','{v}')" for k, v in KEY_CODES.items())
