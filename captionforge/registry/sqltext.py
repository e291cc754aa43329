"""SQL fragments shared by the oracle texts."""

from __future__ import annotations

from captionforge.functions.captions import OPENINGS, REJECT_PHRASES, WHITESPACE


def quote(text: str) -> str:
    """A SQL string literal; control characters go through chr()."""
    parts, plain = [], ""
    for ch in text:
        if ord(ch) < 32 or ord(ch) > 126:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            parts.append(f"chr({ord(ch)})")
        else:
            plain += ch
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def uniform(seed, *keys: str) -> str:
    """The SQL form of hash_uniform; keys are SQL expressions."""
    parts = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def normal(seed, *keys: str) -> str:
    u1 = f"(1.0 - {uniform(seed, *keys, quote('r'))})"
    u2 = uniform(seed, *keys, quote("a"))
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


def trim(text: str) -> str:
    return f"trim({text}, {quote(WHITESPACE)})"


def capitalize(text: str) -> str:
    return f"(upper(substr({text}, 1, 1)) || lower(substr({text}, 2)))"


def strip_all(text: str) -> str:
    for opening, replacement in OPENINGS:
        text = f"replace({text}, {quote(opening)}, {quote(replacement)})"
    return text


def fold_ctes(source: str, column: str, prefix: str = "f") -> tuple[str, str]:
    """Chained CTEs for the capitalised-opening fold; returns (ctes, last name).

    ``source`` must expose ``column``; every CTE passes the other columns through.
    """
    ctes, last = [], source
    for i, (opening, replacement) in enumerate(OPENINGS):
        o = opening[:1].upper() + opening[1:]
        r = replacement[:1].upper() + replacement[1:]
        at = f"instr({column}, {quote(o)})"
        replaced = f"(left({column}, {at} - 1) || {quote(r)} || substr({column}, {at} + {len(o)}))"
        name = f"{prefix}{i}"
        ctes.append(
            f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {at} > 0 THEN {capitalize(replaced)} "
            f"ELSE {column} END AS {column}) FROM {last})"
        )
        last = name
    return ", ".join(ctes), last


def repeats(text: str) -> str:
    terms = [
        f"(length({text}) - length(replace({text}, {quote(p)}, ''))) // {len(p)}" for p in REJECT_PHRASES
    ]
    return "(" + " + ".join(terms) + ")"


def words(text: str) -> str:
    spaced = f"translate({text}, {quote(WHITESPACE)}, {quote(' ' * len(WHITESPACE))})"
    return f"string_split_regex(trim({spaced}, ' '), ' +')"


def dims(doc: str = "documents") -> str:
    """Deterministic image sides derived from the documents table."""
    return f"SELECT doc_id, {FIRST_SIDE} AS h, {SECOND_SIDE} AS w FROM {doc}"


FIRST_SIDE = "CAST(1 + (doc_id * 37) % 2000 AS INTEGER)"
SECOND_SIDE = "CAST(1 + n_chars % 2048 AS INTEGER)"


def nearest(v: str, step: int) -> str:
    return f"({v} + CASE WHEN {step} - ({v}) % {step} < ({v}) % {step} THEN {step} - ({v}) % {step} ELSE -(({v}) % {step}) END)"


def phase(source: str, limit: int = 1024, patch: int = 16) -> str:
    """SELECT adding height and width to ``source`` (columns h, w); failed rows stay with null."""
    sh = nearest(f"CAST(trunc(h * (CAST({limit} AS DOUBLE) / w)) AS INTEGER)", patch)
    sw = nearest(f"CAST(trunc(w * (CAST({limit} AS DOUBLE) / h)) AS INTEGER)", patch)
    return f"""SELECT *, CASE WHEN nh > 0 AND nw > 0 THEN nh END AS height, CASE WHEN nh > 0 AND nw > 0 THEN nw END AS width FROM (
      SELECT *, CASE WHEN h > {limit} OR w > {limit} THEN (CASE WHEN w > h THEN {sh} ELSE {limit} END) ELSE {nearest('h', patch)} END AS nh,
        CASE WHEN h > {limit} OR w > {limit} THEN (CASE WHEN w > h THEN {limit} ELSE {sw} END) ELSE {nearest('w', patch)} END AS nw
      FROM {source})"""
