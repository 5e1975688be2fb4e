"""Pieces of SQL the checks share: the views, the settings, and common steps."""

from __future__ import annotations

from postfunnel.plans import sample, views

NOW = f"TIMESTAMP '{views.CLOCK}'"


def _value(v) -> str:
    if v is None:
        return "NULL"
    return f"'{v}'" if isinstance(v, str) else str(v)


def _policy() -> str:
    rows = ", ".join(
        "(" + ", ".join(_value(x) for x in (
            b.source, b.display_threshold, b.draft_at, b.draft_if_asked_at, b.floor_hourly, b.max_age_days)) + ")"
        for b in sample.profile().boards.values()
    )
    return ("SELECT source, CAST(display_threshold AS INT) AS display_threshold, CAST(draft_at AS INT) AS draft_at, "
            "CAST(draft_if_asked_at AS INT) AS draft_if_asked_at, CAST(floor_hourly AS DOUBLE) AS floor_hourly, "
            f"CAST(max_age_days AS INT) AS max_age_days FROM (VALUES {rows}) "
            "t(source, display_threshold, draft_at, draft_if_asked_at, floor_hourly, max_age_days)")


ANNUAL = """CASE WHEN salary_max IS NULL OR salary_max = 0 THEN NULL
  WHEN currency IS NOT NULL AND upper(currency) <> 'USD' THEN NULL
  WHEN salary_period IS NULL OR lower(salary_period) IN ('annual', 'yearly') THEN salary_max
  WHEN lower(salary_period) = 'monthly' THEN salary_max * 12
  WHEN lower(salary_period) = 'hourly' THEN salary_max * 2080 END"""

# One restriction admits the sample's person.
ADMITS = """(NOT contains(lower(x), 'nation_13') AND (
  contains(lower(x), 'africa') OR contains('africa', lower(x))
  OR contains(lower(x), 'nation_1') OR contains('nation_1', lower(x))
  OR contains(lower(x), 'europe and nation_7') OR contains('europe and nation_7', lower(x))))"""

# Steps of their own, on top of the views.
STEPS = {
    "policy": ([], _policy()),
    "ads": (["postings"], f"""
        SELECT *, CASE WHEN anywhere THEN []::VARCHAR[] ELSE places END AS locs,
          CASE WHEN any_zone THEN []::INT[] ELSE zones END AS offs,
          title || ' ' || category AS hay, {ANNUAL} AS annual_usd FROM postings"""),
    "capabilities": ([], """
        SELECT * FROM (VALUES ('building', false, NULL), ('automobile', NULL, true), ('machinery', true, false))
          t(source, regions_authoritative, publishes_expiry)"""),
    "reasons": (["ads", "policy"], f"""
        SELECT a.*,
          CASE WHEN expires < {NOW} THEN 'expired ' || strftime(expires, '%Y-%m-%d') END AS r1,
          CASE WHEN len(locs) > 0 AND len(list_filter(locs, lambda x: {ADMITS})) = 0
            THEN 'hiring limited to ' || array_to_string(locs[1:3], ', ') END AS r2,
          CASE WHEN len(offs) > 0 AND NOT list_has_any(offs, [0, 1, 2, 3, -5])
            THEN 'requires ' || array_to_string(list_transform(offs[1:4], lambda x: 'UTC' || CASE WHEN x >= 0 THEN '+' ELSE '' END || x), ', ') END AS r3,
          CASE WHEN contains(lower(company), '#000000007') THEN 'blocklisted employer (' || company || ')' END AS r4,
          CASE WHEN annual_usd < floor_hourly * 2080 THEN 'pays up to ' || format('{{:,}}', CAST(annual_usd AS BIGINT))
            || ' USD/yr, floor is ' || format('{{:,}}', CAST(floor_hourly * 2080 AS BIGINT)) END AS r5,
          CASE WHEN regexp_matches(hay, '(?i)anvil') THEN 'excluded title (anvil)'
            WHEN regexp_matches(hay, '(?i)\\bpromo\\b') THEN 'excluded title (\\bpromo\\b)'
            WHEN annual_usd IS NULL AND regexp_matches(hay, '(?i)\\bold\\b')
              THEN '''' || regexp_extract(hay, '(?i)\\bold\\b') || ''' title and no salary stated'
            WHEN annual_usd IS NULL AND regexp_matches(hay, '(?i)large \\w+')
              THEN '''' || regexp_extract(hay, '(?i)large \\w+') || ''' title and no salary stated'
            WHEN NOT regexp_matches(hay, '(?i)bolt|gear|widget|ring|plate') THEN 'title matches no target role' END AS r6
        FROM ads a LEFT JOIN policy USING (source)"""),
    "tagged": (["reasons", "capabilities"], f"""
        SELECT r.*,
          CASE WHEN r1 IS NOT NULL THEN 'expired' WHEN r2 IS NOT NULL THEN 'region' WHEN r3 IS NOT NULL THEN 'timezone'
            WHEN r4 IS NOT NULL THEN 'employer' WHEN r5 IS NOT NULL THEN 'salary' WHEN r6 IS NOT NULL THEN 'role' END AS rejected_by,
          coalesce(r1, r2, r3, r4, r5, r6, '') AS reason,
          CASE WHEN annual_usd IS NULL THEN 'unknown' WHEN annual_usd >= 83200 THEN 'above' ELSE 'below' END AS salary_signal,
          coalesce(annual_usd >= 93600, true) AS clears_inbound,
          len(locs) > 0 AND len(list_filter(locs, lambda x: NOT contains(lower(x), 'nation_1'))) = 0 AS local_anchor,
          CASE WHEN contains(company, '000003') THEN '000003' WHEN contains(company, '00001') THEN '00001' END AS flagged_employer,
          len(locs) = 0 AND NOT coalesce(c.regions_authoritative, true) AS region_unverified
        FROM reasons r LEFT JOIN capabilities c USING (source)"""),
    "survivors": (["tagged"], "SELECT * FROM tagged WHERE rejected_by IS NULL"),
}

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TRIM = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(8232)||chr(8233)||chr(12288)"


def strip(x: str) -> str:
    return f"trim({x}, {TRIM})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')")


def html_text(x: str, entities: dict[str, str] | None = None) -> str:
    """The flattening of display HTML, as nested calls."""
    out = f"regexp_replace(coalesce({x}, ''), '(?i)<(br|/p|/li|/h[1-6]|/div)[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    named = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&apos;": "''", "&nbsp;": " "}
    for entity, char in {**named, **(entities or {})}.items():
        out = f"replace({out}, '{entity}', '{char}')"
    out = rf"regexp_replace({out}, '[ \t\r\f\x0B]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '\n[{SPACE}]*\n[{SPACE}]*', chr(10)||chr(10), 'g')"
    return strip(out)


def sql(body: str, *uses: str) -> str:
    """A check: the views and steps it uses, then its own SELECT."""
    named: list[str] = []
    parts: list[str] = []

    def add(name: str) -> None:
        if name in STEPS:
            needed, text = STEPS[name]
            for other in needed:
                add(other)
            if name not in named:
                named.append(name)
                parts.append(f"{name} AS ({text})")
            return
        for part in views.duck_with(name):
            label = part.split(" AS ", 1)[0]
            if label not in named:
                named.append(label)
                parts.append(part)

    for use in uses:
        add(use)
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
