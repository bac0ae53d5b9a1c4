"""XXH64 in DuckDB's SQL, by its published definition: queries that hash are compared with it.

Numbers are unsigned and kept below 2 ** 64 in 128 bits.
"""

from __future__ import annotations


def mod(x: str) -> str:
    return f"(({x}) % 18446744073709551616::UHUGEINT)"


def _turned(x: str, by: int) -> str:
    return f"(({x} * {2**by}::UHUGEINT) % 18446744073709551616::UHUGEINT + {x} // {2 ** (64 - by)}::UHUGEINT)"


_P = [f"{p}::UHUGEINT" for p in (0, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _settled(h: str) -> str:
    """The last steps of XXH64."""
    return f"""list_reduce([{h}, 33::UHUGEINT, 29::UHUGEINT, 32::UHUGEINT], lambda a, r:
        CASE r WHEN 33 THEN {mod(f"xor(a, a // {2**33}::UHUGEINT) * {_P[2]}")} WHEN 29 THEN {mod(f"xor(a, a // {2**29}::UHUGEINT) * {_P[3]}")}
        ELSE xor(a, a // {2**32}::UHUGEINT) END)"""


def hash_long(value: str, seed: str) -> str:
    """XXH64 of one 64-bit number, both unsigned."""
    fed = f"xor({mod(f'{seed} + {_P[5]} + 8')}, {mod(_turned(mod(f'{value} * {_P[2]}'), 31) + f' * {_P[1]}')})"
    return _settled(mod(f"{_turned(fed, 27)} * {_P[1]} + {_P[4]}"))


def _number(hexes: str, at: str, size: int) -> str:
    """``size`` bytes from byte ``at`` (0-based) of a text of hexadecimal digits, least byte first."""
    return " + ".join(f"('0x' || substr({hexes}, 2 * ({at}) + {2 * i + 1}, 2))::UHUGEINT * {256**i}::UHUGEINT" for i in range(size))


def _lane(k: int, value: str) -> str:
    return mod(f"{_turned(mod(f'v[{k}] + {value} * {_P[2]}'), 31)} * {_P[1]}")


def text_hashes(words: str, seed: int = 42, cte: str = "hashed") -> str:
    """CTEs of a recursive query, the last ``cte`` (word, h): XXH64 of the UTF-8 bytes of the texts ``word`` of a table."""
    eight = _number("x", "p", 8)
    start = [mod(f"{seed} + {_P[1]} + {_P[2]}"), mod(f"{seed} + {_P[2]}"), f"{seed}::UHUGEINT", mod(f"{seed} + 18446744073709551616::UHUGEINT - {_P[1]}")]
    lanes = ", ".join(_lane(k + 1, "(" + _number("x", f"s * 32 + {8 * k}", 8) + ")") for k in range(4))
    gathered = mod(" + ".join(f"{_turned(f'v[{k}]', t)}" for k, t in ((1, 1), (2, 7), (3, 12), (4, 18))))
    steps = ""
    for k in range(1, 5):
        lane = mod(_turned(mod(f"v[{k}] * {_P[2]}"), 31) + f" * {_P[1]}")
        steps += f"""
    merged{k} AS (SELECT *, {mod(f"xor(g{k - 1}, {lane}) * {_P[1]} + {_P[4]}")} AS g{k} FROM {f"merged{k - 1}" if k > 1 else "gathered"}),"""
    return f"""
    hexes AS (SELECT word, hex(encode(word)) AS x, octet_length(encode(word)) AS n FROM {words}),
    lanes AS (
        SELECT word, x, n, 0 AS s, n // 32 AS stripes, [{", ".join(start)}] AS v FROM hexes
        UNION ALL SELECT word, x, n, s + 1, stripes, [{lanes}] FROM lanes WHERE s < stripes),
    gathered AS (SELECT word, x, n, v, {gathered} AS g0 FROM lanes WHERE s = stripes),{steps}
    begun AS (SELECT word, x, n, (n // 32) * 32 AS p, {mod(f"CASE WHEN n >= 32 THEN g4 ELSE {seed} + {_P[5]} END + n::UHUGEINT")} AS h FROM merged4),
    fed AS (
        SELECT word, x, n, p, h FROM begun
        UNION ALL SELECT word, x, n,
            CASE WHEN n - p >= 8 THEN p + 8 WHEN n - p >= 4 THEN p + 4 ELSE p + 1 END,
            CASE WHEN n - p >= 8 THEN {mod(f"{_turned(f'xor(h, {mod(_turned(mod(f'({eight}) * {_P[2]}'), 31) + f' * {_P[1]}')})', 27)} * {_P[1]} + {_P[4]}")}
                 WHEN n - p >= 4 THEN {mod(f"{_turned(f'xor(h, {mod(f"({_number('x', 'p', 4)}) * {_P[1]}")})', 23)} * {_P[2]} + {_P[3]}")}
                 ELSE {mod(f"{_turned(f'xor(h, {mod(f"({_number('x', 'p', 1)}) * {_P[5]}")})', 11)} * {_P[1]}")} END
        FROM fed WHERE p < n),
    {cte} AS (SELECT word, {_settled("h")} AS h FROM fed WHERE p = n)"""
