"""The stemmer as SQL: each step a table with one CASE."""

from __future__ import annotations

from dossierlens.functions import english


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_stems(vocabulary: str) -> str:
    """Tables up to ``stemmed(term, stem)`` of a ``select`` of distinct terms."""

    def base(n: int) -> str:
        return f"substr(w, 1, length(w) - {n})"

    def by_ending(cases: dict[str, str]) -> str:
        fits = "".join(f" when suffix(w, '{e}') then {cases[e]}" for e in english.longest_first(cases))
        return f"case{fits} else w end"

    def cut(endings: dict[str, str], region: str, more: dict[str, str]) -> str:
        return by_ending(
            {
                e: f"case when {more.get(e, f'length(w) - {len(e)} >= {region}')} then {base(len(e))} || '{new}' else w end"
                for e, new in endings.items()
            }
        )

    def past(e: str) -> str:
        b = base(len(e))
        if e.startswith("eed"):
            return f"case when length({b}) >= r1 then {b} || 'ee' else w end"
        return f"""case when not regexp_matches({b}, '{english.VOWELS}') then w
            when regexp_matches({b}, '(at|bl|iz)$') then {b} || 'e'
            when regexp_matches({b}, '{english.DOUBLE_END}') then substr({b}, 1, length({b}) - 1)
            when length({b}) <= r1 and regexp_matches({b}, '{english.SHORT_END}') then {b} || 'e' else {b} end"""

    def region(of: str) -> str:
        first = english.FIRST_REGION
        return f"case when regexp_matches({of}, '{first}') then length(regexp_extract({of}, '{first}')) else length({of}) end"

    prefixes = "".join(f" when starts_with(w, '{p}') then {len(p)}" for p in english.R1_PREFIXES)
    ie = f"case when length(w) > 4 then {base(2)} else {base(1)} end"
    plural = {
        "sses": base(2), "ied": ie, "ies": ie, "us": "w", "ss": "w",
        "s": f"case when regexp_matches({base(2)}, '{english.VOWELS}') then {base(1)} else w end",
    }
    steps = [
        f"regexp_replace(w, {_quoted(english.POSSESSIVE)}, '')",
        by_ending(plural),
        None,
        by_ending({e: past(e) for e in english.PAST}),
        f"case when regexp_matches(w, '^.+[^aeiouy][yY]$') then {base(1)} || 'i' else w end",
        cut(english.STEP2, "r1", {
            "ogi": "length(w) - 3 >= r1 and suffix(w, 'logi')",
            "li": "length(w) - 2 >= r1 and regexp_matches(w, '[cdeghkmnrt]li$')",
        }),
        cut(english.STEP3, "r1", {"ative": "length(w) - 5 >= r2"}),
        cut(english.STEP4, "r2", {"ion": "length(w) - 3 >= r2 and regexp_matches(w, '[st]ion$')"}),
        f"""case when suffix(w, 'e') then
              case when length(w) - 1 >= r2 or length(w) - 1 >= r1 and not regexp_matches({base(1)}, '{english.SHORT_END}')
                then {base(1)} else w end
            when suffix(w, 'll') and length(w) - 1 >= r2 then {base(1)} else w end""",
    ]
    kept = ", ".join(_quoted(k) for k in english.KEPT_AFTER_1A)
    whole = "".join(f" when term = {_quoted(a)} then {_quoted(b)}" for a, b in english.WHOLE_WORDS.items())
    sql = rf"""
vocab as materialized ({vocabulary}),
s_y as materialized (select term, regexp_replace(regexp_replace(replace(term, '’', chr(39)), '^' || chr(39), ''),
                                    '{english.CONSONANT_Y}', '\1Y', 'g') as w from vocab),
s_r1 as materialized (select term, w, case{prefixes} else {region('w')} end as r1 from s_y),
s0 as materialized (select term, w, r1, r1 + {region('substr(w, r1 + 1)')} as r2, null::varchar as kept from s_r1)"""
    for i, expression in enumerate(steps, 1):
        columns = f"kept, {expression} as w" if expression else f"case when w in ({kept}) then w end as kept, w"
        sql += f",\ns{i} as materialized (select term, r1, r2, {columns} from s{i - 1})"
    return sql + f""",
stemmed as materialized (select term, case when length(term) <= 2 then term{whole}
                              else coalesce(kept, replace(w, 'Y', 'y')) end as stem from s{len(steps)})"""
