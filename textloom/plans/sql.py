"""DuckDB expressions that the queries' SQL is made of. Each takes and gives SQL text."""

from __future__ import annotations

from textloom.functions import text as T
from textloom.operators import rules as R
from textloom.operators.rules import Boost, Expansion, RuleSet, Trigger

NL = "chr(10)"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"


def collapse(x: str) -> str:
    x = rf"regexp_replace(coalesce({x}, ''), '\r\n?', {NL}, 'g')"
    x = rf"regexp_replace(replace({x}, chr(160), ' '), '[ \t\f\x0b]+', ' ', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', {NL} || {NL}, 'g')")


def unescape(x: str) -> str:
    for entity, char in T.ENTITIES.items():
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def strip_html(x: str) -> str:
    for tag in ("script", "style", "noscript"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b.*?>.*?</{tag}>', ' ', 'g')"
    return collapse(unescape(f"regexp_replace({x}, '<[^>]+>', {NL}, 'g')"))


def clean_lines(x: str) -> str:
    """Of a stripped text."""
    n = "n"
    starts = " OR ".join(f"starts_with({n}, {lit(s)})" for s in T.BOILERPLATE_STARTS)
    listed = ", ".join(map(lit, T.NAVIGATION_LINES))
    junk = rf"length({n}) <= 1 OR {n} IN ({listed}) OR ends_with({n}, {lit(T.BOILERPLATE_END)}) OR regexp_full_match({n}, '[|·•—\-_=+*/\\]+') OR {starts} OR (length({n}) <= 2 AND NOT regexp_matches({n}, '[一-鿿A-Za-z0-9]'))"
    lines = f"list_filter(list_transform(string_split({x}, {NL}), lambda s: {strip('s')}), lambda n: NOT ({junk}))"
    kept = f"list_transform([{lines}], lambda l: list_filter(l, lambda y, i: i = 1 OR y <> l[i - 1]))[1]"
    return collapse(f"array_to_string({kept}, {NL})")


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([。！？!?；;\n])[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]*', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def units(x: str, max_chars: int = 900) -> str:
    """Of a collapsed text."""
    paragraphs = rf"list_filter(list_transform(string_split_regex({x}, '\n{{2,}}'), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"flatten(list_transform({paragraphs}, lambda p: CASE WHEN length(p) <= {max_chars} THEN [p] ELSE {sentences('p')} END))"


def chunks(units: str, max_chars: int = 900, overlap: int = 120) -> str:
    """Of a list of units."""
    start = "{'done': CAST([] AS VARCHAR[]), 'open': ''}"
    step = (
        "CASE WHEN acc.open = '' THEN {'done': acc.done, 'open': u.open} "
        f"WHEN length(acc.open) + 2 + length(u.open) <= {max_chars} THEN {{'done': acc.done, 'open': acc.open || {NL} || {NL} || u.open}} "
        "ELSE {'done': list_append(acc.done, acc.open), 'open': u.open} END"
    )
    # the accumulator and the items are of one type
    items = f"list_transform({units}, lambda u: {{'done': CAST([] AS VARCHAR[]), 'open': u}})"
    packed = f"list_transform([list_reduce({items}, lambda acc, u: {step}, {start})], lambda r: CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END)[1]"
    return f"list_transform([{packed}], lambda c: list_transform(c, lambda y, i: CASE WHEN i = 1 THEN y ELSE right(c[i - 1], {overlap}) || {NL} || {NL} || y END))[1]"


def canonical_url(x: str) -> str:
    url = f"url_decode({strip(f'coalesce({x}, {lit("")})')})"
    scheme = rf"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"
    rest = rf"regexp_replace({url}, '^[A-Za-z][A-Za-z0-9+.\-]*:', '')"
    host = f"lower(regexp_extract({rest}, '^//([^/?#]*)', 1))"
    path = f"regexp_extract(regexp_replace({rest}, '^//[^/?#]*', ''), '^[^?#]*', 0)"
    path = rf"regexp_replace(regexp_replace({path}, '(?i)/_t\d+/', '/', 'g'), '/+', '/', 'g')"
    path = rf"regexp_replace(regexp_replace({path}, '/+$', ''), '(?i)/main\.(htm|psp)$', '')"
    path = rf"regexp_replace({path}, '(?i)/list\d*\.htm$', '/list.htm')"
    article = rf"replace(regexp_extract({rest}, '^[^?#]*\?([^#]*&)?articleId=([^&#]+)', 2), '+', ' ')"
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE {scheme} || '://' || {host} || {path} || CASE WHEN contains({path}, '_redirect') THEN '?articleId=' || {article} ELSE '' END END"


def signature(x: str) -> str:
    return rf"substring(lower(regexp_replace(regexp_replace({x}, 'https?://[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '', 'g'), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '', 'g')), 1, 120)"


def tokens(x: str) -> str:
    """Of texts without CJK letters, full-width forms and titles."""
    patterns = (r"https?://[^\s\x0b\x1c-\x1f\x{85}\p{Z}，。；、)）>]+", "[a-z0-9_.+-]+@[a-z0-9.-]+", "[a-z0-9][a-z0-9_.@%+-]*")
    found = ", ".join(f"regexp_extract_all(lower({x}), {lit(p)})" for p in patterns)
    return f"list_filter(flatten([{found}]), lambda t: length(t) > 1)"


def snippet(x: str, width: int = 300) -> str:
    flat = f"replace({strip(x)}, {NL}, ' ')"
    return f"CASE WHEN length({flat}) > {width} THEN substring({flat}, 1, {width}) || '...' ELSE {flat} END"


def dates(x: str) -> str:
    found = []
    for pattern in (r"(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})", r"(20\d{2})年\s*(\d{1,2})月\s*(\d{1,2})日?"):
        parts = [f"regexp_extract_all({x}, {lit(pattern)}, {i})" for i in (1, 2, 3)]
        spelled = f"list_transform(list_zip({', '.join(parts)}), lambda z: try_strptime(z[1] || '-' || lpad(z[2], 2, '0') || '-' || lpad(z[3], 2, '0'), '%Y-%m-%d'))"
        found.append(f"list_transform(list_filter({spelled}, lambda d: d IS NOT NULL), lambda d: CAST(d AS DATE))")
    return f"list_concat({', '.join(found)})"


def date_boost(found: str, until: str) -> str:
    fit = f"list_max(list_filter({found}, lambda d: d <= {until}))"
    days = f"greatest(date_diff('day', {fit}, {until}), 0)"
    near = f"greatest(0.0::DOUBLE, 0.055::DOUBLE - least({days}, 3650) / 3650::DOUBLE * 0.055::DOUBLE)"
    newest = f"least(greatest(date_diff('day', DATE '2020-01-01', list_max({found})), 0) / 2500::DOUBLE * 0.05::DOUBLE, 0.05::DOUBLE)"
    return f"CASE WHEN len({found}) = 0 THEN 0.0::DOUBLE WHEN {until} IS NULL THEN {newest} WHEN {fit} IS NULL THEN -0.03::DOUBLE ELSE {near} END"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def all_of(x: str, terms) -> str:
    return "(" + " AND ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def courses(q: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({q}, '《([^》]{{2,40}})》', 1), lambda c: {strip('c')}), lambda c: c <> '')"


def trigger(t: Trigger, q: str) -> str:
    parts = ["TRUE"]
    if t.any:
        parts.append(any_of(q, t.any))
    if t.all:
        parts.append(all_of(q, t.all))
    if t.none:
        parts.append(f"NOT {any_of(q, t.none)}")
    named = {
        "": None,
        "time": any_of(q, R.TIME),
        "founding": any_of(q, R.FOUNDING),
        "exact_url": f"({any_of(q, R.EXACT_URL)} OR ({all_of(q, R.EXACT_URL_BOTH)} AND NOT {any_of(q, R.EXACT_URL_NOT)}))",
        "course": f"len({courses(q)}) > 0",
    }
    if t.predicate:
        parts.append(named[t.predicate])
    return "(" + " AND ".join(parts) + ")"


def expansion_list(rules: RuleSet, q: str) -> str:
    def one(rule: Expansion) -> str:
        return f"CASE WHEN {' OR '.join(trigger(t, q) for t in rule.triggers)} THEN [{lit(rule.added)}] ELSE CAST([] AS VARCHAR[]) END"

    return f"flatten([{', '.join(one(r) for r in R.expansions(rules.site))}, {courses(q)}])"


def route_boost(rules: RuleSet, q: str, title: str, url: str, body: str) -> str:
    hay = f"lower({title} || {NL} || {url} || {NL} || {body})"
    fields = {"hay": hay, "url": f"lower({url})", "title": title, "title_low": f"lower({title})"}

    def test(name: str, terms: tuple[str, ...]) -> str:
        if name == "title_is":
            return f"{title} IN ({', '.join(map(lit, terms))})"
        return all_of(hay, terms) if name == "both" else any_of(fields[name], terms)

    def one(rule: Boost) -> str:
        steps = " ".join(f"WHEN {' AND '.join(test(n, ts) for n, ts in condition)} THEN {delta}::DOUBLE" for condition, delta in rule.steps)
        return f"CASE WHEN NOT {trigger(rule.trigger, q)} THEN 0.0::DOUBLE {steps} ELSE 0.0::DOUBLE END"

    course = f"CASE WHEN len(list_filter({courses(q)}, lambda c: contains({hay}, lower(c)))) > 0 THEN {R.COURSE_BOOST}::DOUBLE ELSE 0.0::DOUBLE END"
    dated = f"CASE WHEN {any_of(q, R.TIME)} THEN {date_boost(dates(hay), f'list_max({dates(q)})')} ELSE 0.0::DOUBLE END"
    return " + ".join([*(one(b) for b in R.boosts(rules.site)), course, dated])
