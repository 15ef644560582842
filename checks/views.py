"""The derived inputs of `checks.fixtures`, stated as SQL common table expressions."""

from steadfast import lexicons as L

STRICT = f"(?i){L.STRICT_URL}"
GREEDY = f"(?i){L.GREEDY_URL}"
TRAIL = L.URL_TRAILING.replace("'", "''")


def h(*parts: str) -> str:
    text = " || '|' || ".join(["'42'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def digest(seed, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"md5({text})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{L.SPACE_CHARS}]+|[{L.SPACE_CHARS}]+\z', '', 'g')"


def urls(text: str) -> str:
    """Distinct normalised strict URLs."""
    return f"list_distinct(list_transform(regexp_extract_all({text}, '{STRICT}'), lambda x: lower(rtrim(x, '{TRAIL}'))))"


def missing(orig: str, rw: str) -> str:
    return f"list_filter({orig}, lambda u: len(list_filter({rw}, lambda r: contains(r, u) OR contains(u, r))) = 0)"


def literals(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


ORIGINAL_ID = (
    "'doc:' || source || (CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN '.mbox' ELSE '' END)"
    " || ':' || doc_id"
)


def _link(i: int) -> str:
    kind, n, url = f"({h(repr('u'), 'doc_id', str(i))} % 8)", f"p{i}", f"u{i}"
    return f"""CASE WHEN {url} IS NULL THEN NULL ELSE CASE {kind}
      WHEN 1 THEN 'http://10.9.2.3/login?x=' || {n} WHEN 2 THEN {url} || '/unsubscribe'
      WHEN 3 THEN 'https://www.paypal.com/p' || {n} WHEN 4 THEN 'http://facebook.com/u' || {n}
      WHEN 5 THEN upper({url}) WHEN 6 THEN {url} || '),'
      WHEN 7 THEN 'www.site' || {n} || '.com/verify' ELSE {url} END END"""


def _kept(i: int) -> str:
    draw = f"({h('doc_id', 'sev', 'generator', 'pos', str(i))} % 10)"
    return f"CASE WHEN {draw} < 1 + 2 * severity THEN NULL WHEN {draw} = 9 THEN url{i} || '/x' ELSE url{i} END"


HOST = f"(CASE WHEN regexp_extract(u, '{L.URL_HOST}', 1) = '' THEN u ELSE regexp_extract(u, '{L.URL_HOST}', 1) END)"


def host_in(names) -> str:
    body = "|".join(n.replace(".", r"\.") for n in names)
    return rf"regexp_matches(host, '(^|\.)({body})$')"


def any_of(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


def strength(u_rel: str, keys: str) -> str:
    """(keys, u, host, strength) for a relation of (keys, u)."""
    ask, brand = any_of("u", L.ASK_PATHS), host_in(L.KNOWN_BRANDS)
    incidental = (
        f"({host_in(L.INCIDENTAL_HOSTS)} OR (host LIKE 'click%' AND contains(host, 'ebay'))"
        f" OR regexp_matches(u, '{L.ASSET_SUFFIX}') OR {any_of('u', L.INCIDENTAL_PATHS)})"
    )
    return f"""SELECT {keys}, u, host, CASE WHEN {incidental} THEN -1 ELSE
      (CASE WHEN regexp_matches(host, '{L.IPV4_HOST}') THEN 3 ELSE 0 END)
      + (CASE WHEN {ask} THEN 2 ELSE 0 END) + (CASE WHEN {brand} THEN 0 ELSE 1 END) END AS strength
      FROM (SELECT {keys}, u, {HOST} AS host FROM {u_rel})"""


REFUSED = any_of("lower(rewrite_text)", [m.replace("'", "''") for m in L.REFUSAL_MARKERS])

PARSED_TEXT = (
    f"CASE WHEN lower(substr({strip('raw')}, 1, 8)) = 'subject:' THEN "
    + strip(
        f"{strip('substr(split_part(' + strip('raw') + ', chr(10), 1), 9)')} || chr(10) || "
        + strip(
            f"CASE WHEN instr({strip('raw')}, chr(10)) > 0 THEN substr({strip('raw')}, instr({strip('raw')}, chr(10)) + 1) ELSE '' END"
        )
    )
    + f" ELSE {strip('raw')} END"
)

MODELS = "('logreg'), ('random_forest'), ('gradient_boosting')"

VIEWS = {
    "docs_v": f"""SELECT doc_id, source, CAST(substr(source, 4) AS INT) AS source_rank, {ORIGINAL_ID} AS original_id,
      split_part(text, chr(10), 1) AS subject,
      CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body,
      doc_id % 2 = 0 AS had_html FROM documents""",
    "emails_v": f"""SELECT doc_id, source, label, {ORIGINAL_ID} AS original_id, doc_text, url0, url1,
      concat_ws(' ', doc_text, url0, url1) AS text, doc_id % 2 = 0 AS had_html
      FROM (SELECT *, {_link(0)} AS url0, {_link(1)} AS url1 FROM (
        SELECT d.doc_id, d.source, coalesce(l.toxic, 0) AS label, d.text AS doc_text, a.page_id AS p0, a.url AS u0,
          b.page_id AS p1, b.url AS u1
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        LEFT JOIN pages a ON a.page_id = CASE WHEN d.doc_id % 5 < 4 THEN d.doc_id % (SELECT count(*) FROM pages) END
        LEFT JOIN pages b ON b.page_id = CASE WHEN d.doc_id % 3 = 0 THEN (d.doc_id + 7) % (SELECT count(*) FROM pages) END))""",
    "log_v": f"""SELECT doc_id, original_id, source, generator, severity, sev, pos, text AS original_text,
      'Subject: re ' || doc_id || chr(10) || concat_ws(' ',
        CASE WHEN {h(repr('r'), 'doc_id', 'sev', 'generator', 'pos')} % 20 = 0 THEN 'I am unable to do that.' END,
        array_to_string(list_slice(tokens, 1, CAST(ceil(len(tokens) * (1 - severity / 2)) AS INT)), ' '),
        {_kept(0)}, {_kept(1)}) AS raw
      FROM (SELECT *, string_split(doc_text, ' ') AS tokens FROM emails_v
        CROSS JOIN (VALUES (0.25::DOUBLE, '0.25'), (0.5, '0.50'), (0.75, '0.75'), (1.0, '1.00')) s(severity, sev)
        CROSS JOIN (VALUES ('g1'), ('g2')) g(generator) CROSS JOIN (VALUES (1), (2)) w(pos)
        WHERE label = 1)
      WHERE pos = 1 OR {h(repr('w'), 'doc_id', 'sev', 'generator')} % 3 = 0""",
    "last_v": f"""SELECT * EXCLUDE (rn), {PARSED_TEXT} AS rewrite_text FROM (
      SELECT *, row_number() OVER (PARTITION BY original_id, severity, generator ORDER BY pos DESC) AS rn FROM log_v)
      WHERE rn = 1""",
    "prim_v": f"""SELECT original_id, list(u) AS prim FROM (
        SELECT *, max(strength) OVER (PARTITION BY original_id) AS best FROM (
          {strength(f"(SELECT original_id, unnest({urls('text')}) AS u FROM emails_v)", "original_id")}))
      WHERE strength = best AND strength >= 0 GROUP BY original_id""",
    "rewrites_v": f"""SELECT *, CASE WHEN len(orig) > 0 THEN len(missing) = 0 END AS retained_urls,
        CASE WHEN len(prim) > 0 THEN len(missing_prim) = 0 END AS retained_primary, {REFUSED} AS refused
      FROM (SELECT *, {missing('orig', 'rw')} AS missing, {missing('prim', 'rw')} AS missing_prim
        FROM (SELECT l.*, {urls('l.original_text')} AS orig, {urls('l.rewrite_text')} AS rw,
            coalesce(p.prim, []) AS prim
          FROM last_v l LEFT JOIN prim_v p ON l.original_id = p.original_id))""",
    "ids_v": f"SELECT {ORIGINAL_ID} AS row_id, toxic AS label, doc_id, source FROM documents JOIN labels USING (doc_id)",
    "neg_v": f"""SELECT *, floor(({h(repr('n'), 'model', 'condition', 'training', 'row_id')} / 4294967296.0) * 0.6::DOUBLE * 10000) / 10000.0::DOUBLE AS score
      FROM ids_v CROSS JOIN (VALUES {MODELS}) m(model) CROSS JOIN (VALUES ('original'), ('url_masked')) c(condition)
      CROSS JOIN (VALUES ('baseline'), ('adv_trained')) t(training) WHERE label = 0""",
    "pos_v": f"""SELECT *, floor((0.35::DOUBLE + 0.65::DOUBLE * ({h(repr('p'), 'model', 'condition', 'training', "CASE WHEN severity > 0 THEN generator ELSE 'na' END", 'sev', 'row_id')} / 4294967296.0)
        - severity * ((CASE WHEN condition = 'url_masked' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END) * (CASE WHEN training = 'adv_trained' THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END))) * 10000) / 10000.0::DOUBLE AS score
      FROM ids_v CROSS JOIN (VALUES {MODELS}) m(model) CROSS JOIN (VALUES ('original'), ('url_masked')) c(condition)
      CROSS JOIN (VALUES ('baseline'), ('adv_trained')) t(training) CROSS JOIN (VALUES ('g1'), ('g2')) g(generator)
      CROSS JOIN (VALUES (0.0::DOUBLE, '0.00'), (0.25, '0.25'), (0.5, '0.50'), (0.75, '0.75'), (1.0, '1.00')) s(severity, sev)
      WHERE label = 1""",
}
NEEDS = {
    "docs_v": (), "emails_v": (), "ids_v": (), "log_v": ("emails_v",), "last_v": ("log_v",),
    "prim_v": ("emails_v",), "rewrites_v": ("last_v", "prim_v"), "neg_v": ("ids_v",), "pos_v": ("ids_v",),
}


def q(views: str, select: str, **extra: str) -> str:
    """A full statement: the named views, then extra CTEs, then the select."""
    wanted, order = [], list(VIEWS)

    def add(name):
        for parent in NEEDS[name]:
            add(parent)
        if name not in wanted:
            wanted.append(name)

    for name in views.split():
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in sorted(wanted, key=order.index)]
    parts += [f"{n} AS ({body})" for n, body in extra.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select
