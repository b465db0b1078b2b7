"""Scalar functions of the engine as SQL expression templates.

Each function takes the SQL text of its argument (a column name or any expression) and
returns SQL text, so that the same definition serves ``F.expr``, lambda bodies and the SQL
functions registered by ``register_functions``.
"""

from .. import schema


# Characters taken out one by one before the rest is counted by its distinct characters.
PEELED = 64


def _peel(x, gain):
    """Fold over the characters of a text: SQL of ``sum(gain(count of the character))``.

    Each step removes all copies of the first character that is left, so frequent characters go
    early and the text shrinks fast: no array with one element per character is built.
    """
    step = ("if(s.len = 0, s, transform(array(replace(s.rest, left(s.rest, 1), '')), r -> transform(array(length(r)), "
            f"n -> named_struct('rest', r, 'len', n, 'sum', s.sum + {gain('(s.len - n)')}))[0])[0])")
    start = "named_struct('rest', t, 'len', length(t), 'sum', 0D)"
    tail = ("aggregate(if(s.len = 0, cast(array() as array<string>), array_distinct(regexp_extract_all(s.rest, '(?s).', 0))), "
            f"s.sum, (a, c) -> a + transform(array(s.len - length(replace(s.rest, c, ''))), k -> {gain('k')})[0])")
    return (f"transform(array({x}), t -> transform(array(octet_length(t)), bytes -> "
            f"aggregate(sequence(1, {PEELED}), {start}, (s, i) -> {step}, s -> {tail}))[0])[0]")


def _entropy(x, log):
    def gain(count):
        share = f"(cast({count} as double) / bytes)"
        return f"transform(array({share}), p -> -p * {log.format(p='p')})[0]"
    return f"if({x} = '', 0D, {_peel(x, gain)})"


def shannon_entropy(x):
    """Bits per byte: character counts over the byte length."""
    return _entropy(x, "log2({p})")


def entropy_base(x, base):
    """Entropy in another base, scaled once more by the natural log of the base."""
    return f"({_entropy(x, 'log(' + str(base) + ', {p})')} / ln({base}))"


def information_density(x):
    """Distinct characters over the byte length."""
    return f"if({x} = '', 0D, {_peel(x, lambda count: '1D')} / octet_length({x}))"


def classify_entropy(x):
    cases = " ".join(f"when {x} < {limit}D then '{name}'" for limit, name in schema.ENTROPY_LIMITS)
    return f"case {cases} else 'very_high' end"


def is_base64(x):
    letters = f"length(regexp_replace({x}, '[^A-Za-z]', ''))"
    return (f"(octet_length({x}) >= 4 and {x} rlike '^[A-Za-z0-9+/=]+\\\\z' and (endswith({x}, '=') or "
            f"({letters} / octet_length({x}) > 0.5 and octet_length({x}) % 4 = 0)))")


def is_hex(x):
    return f"(octet_length({x}) >= 4 and octet_length({x}) % 2 = 0 and {x} rlike '^[0-9A-Fa-f]+\\\\z')"


def guessability(x):
    return f"({shannon_entropy(x)} / 8D * 70D + {information_density(x)} * 30D)"


def _lookup(x, table, default):
    cases = " ".join(f"when '{k}' then {v}" for k, v in table.items())
    return f"case {x} {cases} else {default} end"


def severity_weight(x):
    return _lookup(x, schema.SEVERITY_WEIGHTS, schema.UNKNOWN_SEVERITY_WEIGHT)


def severity_rank(x):
    return _lookup(x, {"critical": 4, "high": 3, "medium": 2, "low": 1}, 0)


def confidence_rank(x):
    return _lookup(x, {"high": 3, "medium": 2, "low": 1}, 0)


def confidence_multiplier(x):
    table = {k: f"{v}D" for k, v in schema.CONFIDENCE_FACTORS.items()}
    return _lookup(x, table, f"{schema.UNKNOWN_CONFIDENCE_FACTOR}D")


def confidence_tenths(x):
    table = {k: round(v * 10) for k, v in schema.CONFIDENCE_FACTORS.items()}
    return _lookup(x, table, round(schema.UNKNOWN_CONFIDENCE_FACTOR * 10))


def category_weight(x):
    table = {k: f"{v}D" for k, v in schema.CATEGORY_WEIGHTS.items()}
    return _lookup(x, table, f"{schema.UNKNOWN_CATEGORY_WEIGHT}D")


def category_tenths(x):
    table = {k: round(v * 10) for k, v in schema.CATEGORY_WEIGHTS.items()}
    return _lookup(x, table, round(schema.UNKNOWN_CATEGORY_WEIGHT * 10))


def normalize_severity(x):
    names = "'critical', 'high', 'medium', 'low'"
    low = f"lower(trim({x}))"
    return (f"case when {low} = 'crit' then 'critical' when {low} = 'med' then 'medium' "
            f"when {low} in ({names}) then {low} else 'medium' end")


def normalize_confidence(x):
    low = f"lower(trim({x}))"
    return (f"case when {low} = 'med' then 'medium' when {low} in ('high', 'medium', 'low') "
            f"then {low} else 'medium' end")


def risk_level(x):
    cases = " ".join(f"when {x} < {limit} then '{name}'" for limit, name in schema.RISK_LIMITS)
    return f"case when {x} <= 0 then 'none' {cases} else 'critical' end"


def risk_level_value(x):
    return _lookup(x, {name: i for i, name in enumerate(schema.RISK_LEVELS)}, "cast(null as int)")


def risk_description(level, count, score):
    tail = f"' risk - ' || {count} || ' findings, score: ' || {score}"
    return (f"case {level} when 'none' then 'No risk detected' when 'critical' then 'CRITICAL' || {tail} "
            f"else initcap({level}) || {tail} end")


def sarif_level(x):
    return f"case when {x} in ('critical', 'high') then 'error' when {x} = 'medium' then 'warning' " \
           f"when {x} = 'low' then 'note' else 'none' end"


def language(path):
    """Language of a path by its extension; null when there is none on the list."""
    extension = f"lower(regexp_extract({path}, '\\\\.([^./]+)\\\\z', 1))"
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in schema.LANGUAGES.items())
    return f"case {extension} {cases} end"


def clone_type(x):
    return f"case when {x} >= 0.98 then 1 when {x} >= 0.85 then 2 when {x} >= 0.75 then 3 else 4 end"


def clone_type_description(x):
    return (f"case {x} when 1 then 'identical but for white space' when 2 then 'identical but for names' "
            f"when 3 then 'similar with small changes' else 'different code, same behaviour' end")


def fingerprint(rule, source, line, matched):
    return f"concat_ws(':', {rule}, {source}, {line}, {matched})"


def truncated(x, limit=60):
    """Cut only when the byte length is over the limit, and then after ``limit`` characters."""
    return (f"if(octet_length({x}) > {limit} and length({x}) > {limit}, "
            f"substring({x}, 1, {limit}) || '...', {x})")


# name -> (parameters, return type, body)
SQL_FUNCTIONS = {
    "sw_shannon_entropy": ("x STRING", "DOUBLE", shannon_entropy("x")),
    "sw_information_density": ("x STRING", "DOUBLE", information_density("x")),
    "sw_classify_entropy": ("x DOUBLE", "STRING", classify_entropy("x")),
    "sw_is_base64": ("x STRING", "BOOLEAN", is_base64("x")),
    "sw_is_hex": ("x STRING", "BOOLEAN", is_hex("x")),
    "sw_guessability": ("x STRING", "DOUBLE", guessability("x")),
    "sw_severity_weight": ("x STRING", "INT", severity_weight("x")),
    "sw_confidence_multiplier": ("x STRING", "DOUBLE", confidence_multiplier("x")),
    "sw_risk_level": ("x BIGINT", "STRING", risk_level("x")),
    "sw_sarif_level": ("x STRING", "STRING", sarif_level("x")),
    "sw_language": ("x STRING", "STRING", language("x")),
    "sw_fingerprint": ("rule STRING, source STRING, line BIGINT, matched STRING", "STRING",
                       fingerprint("rule", "source", "line", "matched")),
}


def register_functions(spark):
    """Make the functions callable from SQL, as temporary SQL functions (no Python involved)."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return sorted(SQL_FUNCTIONS)
