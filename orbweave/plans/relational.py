"""Texts of SQL that several queries' oracles share."""


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 5e-1) / 1e6"


def mean(x: str) -> str:
    """The mean of numbers of five decimals: an exact sum, divided once."""
    return f"CAST(sum(CAST(round({x} * 100000) AS BIGINT)) AS DOUBLE) / (count(*) * 1e5)"


RULES = """CASE WHEN p_name IS NULL OR p_type IS NULL THEN 'required field missing' WHEN trim(p_name) = '' THEN 'name must be a non-empty string'
WHEN p_size < 1 OR p_size > 45 THEN concat('size = ', CAST(p_size AS VARCHAR(20)), ' is outside 1-45') WHEN p_retailprice < 905 OR p_retailprice > 1900 THEN 'price outside 905-1900'
WHEN p_retailprice / (p_size * p_size * p_size) > 500 THEN 'density is implausible' WHEN p_type = 'PROMO' THEN 'type is not allowed' END"""
