"""The same results in DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

from coratia.llm import mining, mixing, preferences, quality, secrets


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def warc_sql() -> str:
    digits = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {g * 5 + 1}, 5))::bigint >> {s}) & 31)::int + 1, 1)"
        for g in range(8)
        for s in (15, 10, 5, 0)
    )
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    return rf"""
with pages_read as (
    select page_id, coalesce(url, '') url, coalesce(html, '') html, sha1(coalesce(html, '')) hex from pages
), digested as (
    select *, {digits} payload_digest, octet_length(encode(html)) payload_bytes,
           min(page_id) over (partition by html) first_id
    from pages_read
), keyed as (
    select *,
        strftime(timestamp '2024-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') captured_at,
        lower(regexp_extract(url, '{scheme}(?:[^@/?#]*@)?(?:www[0-9]*\.)?([^/:?#]*)', 1)) host,
        regexp_extract(url, '{scheme}[^/?#]*([^#]*)', 1) rest
    from digested
), named as (
    select *, case when regexp_matches(url, '{scheme}')
        then array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when rest = '' then '/' else rest end
        else url end url_key
    from keyed
)
select page_id, payload_bytes::bigint payload_bytes, payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end record_type,
    case when page_id = first_id then null else first_id end refers_to,
    url_key, captured_at, row_number() over (order by url_key, captured_at, page_id) - 1 capture_no
from named
"""


def secrets_sql() -> str:
    kinds = []
    value = f"regexp_extract(m, {_text(secrets.ASSIGN)}, 2)"
    for rank, (kind, pattern, found, keep) in enumerate(
        [
            ("assign", secrets.ASSIGN, value, f"length({value}) >= {secrets.LEAST_ASSIGN}"),
            # A run is matched whole, so asking for its least length in the pattern finds the same runs.
            ("access", secrets.ACCESS[:-1] + f"{{{secrets.LEAST_ACCESS - 4},}}", "m", "true"),
            ("hex", secrets.HEX[:-1] + f"{{{secrets.LEAST_HEX},}}", "m", "true"),
            *[
                (
                    kind,
                    pattern,
                    f"regexp_extract(m, {_text(pattern)}, 1)",
                    "regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')"
                    if kind == "mixed"
                    else "true",
                )
                for kind, pattern in secrets.WIDE.items()
            ],
        ]
    ):
        # Text outside and inside the matches; the k-th match begins after k outer and k - 1 inner pieces.
        kinds.append(f"""
select doc_id, owner, {rank} as rank, '{kind}' as kind, start, start + length(m) as stop, {found} as val from (
    select doc_id, owner, unnest(ms) m,
        unnest(list_transform(range(1, len(ms) + 1), lambda k: list_sum(list_transform(outer_[1:k], lambda x: length(x)))
            + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0)))::bigint start
    from (
        select doc_id, owner, regexp_extract_all(body, {_text(pattern)}) ms, regexp_split_to_array(body, {_text(pattern)}) outer_
        from bodies where regexp_matches(body, {_text(pattern)})
    )
) where {keep}""")
    last = len(secrets.BASE_KINDS) - 1
    return f"""
with bodies as (select doc_id, coalesce(source, '') owner, coalesce(text, '') body from documents),
every as materialized ({" union all ".join(kinds)}),
free as materialized (
    select * from every w where rank <= {last} or not exists (
        select 1 from every b where b.doc_id = w.doc_id and b.rank <= {last} and b.start <= w.start and w.stop <= b.stop)
),
held as (select val, count(distinct owner) owners, count(distinct doc_id) repositories from free group by val),
judged as materialized (
    select free.*, owners, repositories, owners >= {secrets.EXAMPLE_OWNERS} and repositories >= {secrets.EXAMPLE_REPOSITORIES} example
    from free join held using (val)
),
kept as (
    select * from judged w where rank <= {last} or not example and not exists (
        select 1 from judged v where v.doc_id = w.doc_id and v.rank > {last} and not v.example and v.rank < w.rank
            and v.start <= w.start and w.stop <= v.stop)
),
told as (
    select doc_id,
        count(*) filter (rank = 0) n_assign, count(*) filter (rank = 1) n_access, count(*) filter (rank = 2) n_hex,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank <= {last}), '') base,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank), '') spans,
        string_agg(repositories || ':' || owners, ',' order by start, rank) holders,
        count(*) filter (example) n_examples, count(*) filter (not example) n_live
    from kept group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
    sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(holders, '') holders,
    coalesce(n_examples, 0) n_examples, coalesce(n_live, 0) n_live
from documents d left join told using (doc_id)
"""


def mixing_sql() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    most = mixing.MOST
    # Rounds of capping; each caps one source more at least, and the rounds after the last change nothing.
    rounds = 12
    shares = ["round0 as (select *, false capped from weighted)"]
    for k in range(1, rounds + 1):
        shares.append(f"""round{k} as (
    select source, source_size, weight, capped or (
        (sum(source_size) over () - coalesce(sum(source_size * {most}) filter (capped) over (), 0))::double * weight
        / coalesce(sum(weight) filter (not capped) over (), 1)::double > source_size * {most}) capped from round{k - 1})""")
    return rf"""
with sizes as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5(coalesce(text, '')) text_md5 from documents
),
totals as (select source, sum(size)::bigint source_size from sizes group by source),
weighted as (
    select source, source_size, ([{weights}])[((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1)::int]::bigint weight
    from totals
),
{", ".join(shares)},
targets as (
    select source, source_size, case when capped then (source_size * {most})::double else
        (sum(source_size) over () - coalesce(sum(source_size * {most}) filter (capped) over (), 0))::double * weight
        / coalesce(sum(weight) filter (not capped) over (), 1)::double end target
    from round{rounds}
),
drawn as (
    select *, greatest(1, {mixing.PREFERENCES} - length(bin(size)))::bigint g,
        (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, text_md5)), 1, 12))::bigint::double + 0.5) / {1 << 48}::double u
    from sizes
),
classes as (select source, g, sum(size)::bigint words from drawn group by all),
laid as (
    select source, g, coalesce(sum(words) over (partition by source order by g desc rows between unbounded preceding and 1 preceding), 0) capped,
        sum(words * g) over (partition by source order by g desc rows between current row and unbounded following) spread
    from classes
),
scaled as (
    select l.source, source_size, target, coalesce(min_by(scale, -g) filter (scale * g <= {most}), {most}) scale from (
        select *, (target - {most} * capped) / nullif(spread, 0) scale from laid join targets on laid.source is not distinct from targets.source
    ) l group by all
),
expected as (
    select d.*, s.source_size, s.target, case when size > 0 then least({most}::double, s.scale * g) else 0::double end e
    from drawn d join scaled s on d.source is not distinct from s.source
),
placed as (
    select *, floor(e)::bigint whole, e - floor(e) p,
        case when e - floor(e) > 0 then u * (1 - (e - floor(e))) / (u * (1 - (e - floor(e))) + (1 - u) * (e - floor(e))) end place
    from expected
),
wanted as (select source, any_value(target) - sum(size * whole) wanted from placed group by source),
-- Alike rows stand side by side; each has a number of its own.
running as (
    select p.*, wanted, sum(size) filter (place is not null) over ordered reached, row_number() over ordered number
    from placed p join wanted w on p.source is not distinct from w.source
    window ordered as (partition by p.source order by place nulls last, doc_id nulls first, size rows between unbounded preceding and current row)
),
-- Slices that begin beyond what is wanted are not looked at, so the cut is the last end that is not beyond.
cuts as (
    select source, any_value(wanted) wanted, coalesce(max(reached) filter (reached <= wanted), 0) reached
    from running where place is not null group by source
),
closing as (
    select r.source, arg_min(r.number, (abs(c.wanted - c.reached - r.size), r.number)) closing
    from running r join cuts c on r.source is not distinct from c.source
    where place is not null and r.reached > c.wanted and abs(c.wanted - c.reached - r.size) < c.wanted - c.reached group by r.source
),
told as (
    select r.*, (whole + case when place is not null and (reached <= wanted or number = closing) then 1 else 0 end)::bigint copies
    from running r left join closing c on r.source is not distinct from c.source
)
select doc_id, size, source_size, target, (size * copies)::bigint taken, copies from told
"""


def preferences_sql() -> str:
    start, end = preferences.OPEN, preferences.CLOSE
    return rf"""
with given as (
    select conv_id, coalesce(turn, {preferences._LAST}) turn, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null
),
answers as (select conv_id, max((turn, text)) own from given where role = '{preferences.LEARNT}' group by conv_id),
-- The rejected side has the answer of the next conversation; after the last comes the first.
swaps as (
    select conv_id, own, coalesce(lead(own) over (order by conv_id), first_value(own) over (order by conv_id))[2] given from answers
),
turns as (
    select conv_id pair_id, 0 side, turn, role, text from given
    union
    select g.conv_id, 1, turn, role, case when role = '{preferences.LEARNT}' and (turn, text) = own then given else text end
    from given g left join swaps using (conv_id)
),
shared as (
    select *, (row_number() over (partition by pair_id order by turn, role, text) - 1) // {preferences.PIECE_TURNS} piece
    from (select pair_id, turn, role, text, count(*) n from turns group by all)
),
borders as (select pair_id, min(turn) filter (n = 1) border from shared group by pair_id),
parts as (
    select t.*, piece, t.turn >= coalesce(border, 9223372036854775807) after,
        '{start}' || replace(t.role, '<|', '< |') || chr(10) head, replace(t.text, '<|', '< |') || '{end}' body
    from turns t join borders using (pair_id) join shared s
        on s.pair_id = t.pair_id and s.turn = t.turn and s.role = t.role and s.text = t.text
),
placed as (
    select *, coalesce(sum(length(head) + length(body) + 1) over (
        partition by pair_id, piece, side, after order by turn, role, text rows between unbounded preceding and 1 preceding), 0) at_
    from parts
)
select pair_id, piece,
    coalesce(string_agg(head || body || chr(10), '' order by turn, role, text) filter (not after and side = 0), '') prompt,
    coalesce(string_agg(head || body || chr(10), '' order by turn, role, text) filter (after and side = 0), '') chosen,
    coalesce(string_agg(head || body || chr(10), '' order by turn, role, text) filter (after and side = 1), '') rejected,
    coalesce(string_agg((at_ + length(head))::bigint || ':' || (at_ + length(head) + length(body))::bigint, ',' order by turn, role, text)
        filter (after and side = 0 and role = '{preferences.LEARNT}'), '') chosen_learnt,
    coalesce(string_agg((at_ + length(head))::bigint || ':' || (at_ + length(head) + length(body))::bigint, ',' order by turn, role, text)
        filter (after and side = 1 and role = '{preferences.LEARNT}'), '') rejected_learnt
from placed group by pair_id, piece
"""


# The rules of the votes, as conditions for bad and for good, over the counts of a text.
_RULES = {
    "symbols": ("symbols > 0.2", "symbols < 0.02"),
    "symbol_share": ("share > 0.04", "share < 0.004"),
    "symbol_ends": ("ends > 0.15", "ends < 0.01"),
    "bare_words": ("bare > 0.15", "bare < 0.02"),
    "repeated_words": ("again > 0.35", "again < 0.1"),
    "repeated_lines": ("lines > 0.4 and n_dup_lines > 2", "lines < 0.2"),
    "stutters": ("stutters > 0.2", "stutters < 0.05"),
    "variety": (
        "distincts < case when n_words >= 2000 then 0.05 else 0.15 end",
        "distincts > case when n_words >= 2000 then 0.1 else 0.3 end",
    ),
    "capitals": ("upper_ > 0.3", "upper_ < 0.1"),
    "marks": ("marks > 0.3", "marks < 0.05"),
    "word_length": ("mean < 2.5 or mean > 12", "mean between 3 and 9"),
}


def quality_sql() -> str:
    word, blank = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"

    def found(characters: str) -> str:
        return f"length(body) - length(regexp_replace(body, '{characters}', '', 'g'))"

    votes = ", ".join(
        f"case when ({bad}) is null then 0 when {bad} then -1 when {good} then 1 else 0 end v_{rule}"
        for rule, (bad, good) in _RULES.items()
    )
    names = ", ".join(f"v_{rule}" for rule in _RULES)
    bad_votes = " + ".join(f"(v_{rule} = -1)::int" for rule in _RULES)
    ballots = " union all ".join(f"select pid, '{rule}' as rule, v_{rule} as vote from patterns" for rule in _RULES)
    cells = ", ".join(f"('{rule}', {vote})" for rule in _RULES for vote in (-1, 0, 1))
    rounds = []
    for k in range(1, quality.ROUNDS + 1):
        rounds.append(f"""
s{k} as materialized (
    select c.rule, c.vote, sum(case when b.vote = c.vote then good * n else 0 end) + {quality.SMOOTH}::double a,
        sum(case when b.vote = c.vote then (1 - good) * n else 0 end) + {quality.SMOOTH}::double z
    from cells c join ballots b on b.rule = c.rule join g{k - 1} using (pid) group by 1, 2
),
o{k} as materialized (
    select rule, vote, case vote when -1 then least(x, 0) when 1 then greatest(x, 0) else x end x from (
        select rule, vote, ln(a / sum(a) over (partition by rule)) - ln(z / sum(z) over (partition by rule)) x from s{k})
),
b{k} as materialized (
    select ln(share / (1 - share)) bias from (select (sum(good * n) + {quality.SMOOTH}) / (sum(n) + 2 * {quality.SMOOTH}) share from g{k - 1})
),
g{k} as materialized (
    select pid, any_value(n) n, 1 / (1 + exp(-(any_value(bias) + sum(x)))) good
    from g{k - 1} join ballots using (pid) join o{k} using (rule, vote), b{k} group by pid
)""")
    return rf"""
with texts as (
    select doc_id, coalesce(text, '') body, regexp_extract_all(coalesce(text, ''), '{word}') w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{blank}')) l
    from documents
),
windows as (
    select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) times
    from (select doc_id, w, unnest(range(1, len(w) - 1)) i from texts)
),
covered as (
    select doc_id, count(distinct at_) n from (select doc_id, unnest([i, i + 1, i + 2]) at_ from windows where times > 1) group by doc_id
),
counts as (
    select t.doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
        {found("[#*$%&|<>]")} n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(c.n, 0) n_repeat_words,
        len(l) n_lines, {found("[A-Z]")} n_upper, len(list_distinct(w)) n_distinct,
        len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) n_ends,
        len(list_filter(w, lambda x: not regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) n_bare,
        {found("[!?]")} n_marks, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) n_stutters
    from texts t left join covered c using (doc_id)
),
shares as (
    select *, n_symbols / nullif(n_words, 0)::double symbols, n_symbols / nullif(word_chars, 0)::double share,
        n_ends / nullif(n_words, 0)::double ends, n_bare / nullif(n_words, 0)::double bare, n_repeat_words / nullif(n_words, 0)::double again,
        n_dup_lines / nullif(n_lines, 0)::double lines, n_stutters / nullif(n_words, 0)::double stutters,
        n_distinct / nullif(n_words, 0)::double distincts, n_upper / nullif(word_chars, 0)::double upper_,
        n_marks / nullif(n_words, 0)::double marks, word_chars / nullif(n_words, 0)::double mean
    from counts
),
voted as materialized (select *, {votes} from shares),
patterns as materialized (select *, row_number() over (order by {names}) pid from (select {names}, count(*) n from voted group by all)),
ballots as materialized ({ballots}),
cells(rule, vote) as (values {cells}),
g0 as materialized (select pid, n, case when {bad_votes} >= 2 then {1 - quality.PRIOR!r} else {quality.PRIOR} end::double good from patterns),
{", ".join(rounds)}
select doc_id, n_words::bigint n_words, word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
    n_repeat_words::bigint n_repeat_words,
    n_words < {quality.FEWEST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words base_failed,
    round(good, 6) p_good,
    not (n_words < {quality.FEWEST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) and good >= {quality.KEEP_FROM} kept
from voted join patterns using ({names}) join g{quality.ROUNDS} using (pid)
"""


def merkle_sql() -> str:
    """Trees level by level; more levels than any tree has change nothing, as a lone node stays as it is."""
    levels = 14

    def leaf(text: str) -> str:
        parts = [
            f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end" for c in ("doc_id", "source", "lang", "n_chars", text)
        ]
        return f"sha256({' || '.join(parts)})"

    crc = "list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0])), "
    crc += "lambda c, b: (xor(c, b) >> 1) ^ ((xor(c, b) & 1) * 3988292384), 4294967295)"
    crc = crc.replace("(xor(c, b) >> 1) ^ ((xor(c, b) & 1) * 3988292384)", "xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)")

    def tree(name: str, base: str, key: str) -> list[str]:
        """name0 .. nameN: (key, i, n, digest); i counts inside the tree of that key, which has n nodes on the level."""
        made = [f"{name}0 as materialized ({base})"]
        for k in range(1, levels + 1):
            made.append(f"""{name}{k} as materialized (
    select {key}, case when n > 1 then i // 3 else i end i, max(case when n > 1 then (n + 2) // 3 else n end) n,
        case when max(n) > 1 then sha256(string_agg(digest, '' order by i)) else max(digest) end digest
    from {name}{k - 1} group by all)""".replace("group by all", f"group by {key}, case when n > 1 then i // 3 else i end"))
        return made

    def climb(name: str, start: str, nodes: str, key: str, place: str) -> list[str]:
        """name0 .. nameN: what becomes of a row's digest `up`, and the siblings met so far."""
        made = [f"{name}0 as materialized ({start})"]
        for k in range(1, levels + 1):
            made.append(f"""{name}{k} as materialized (
    select r.rid, r.{key}, case when any_value(x.n) > 1 then any_value(r.{place}) // 3 else any_value(r.{place}) end {place},
        case when any_value(x.n) > 1 then sha256(string_agg(case when x.i = r.{place} then r.up else x.digest end, '' order by x.i)) else any_value(r.up) end up,
        any_value(r.proof) || coalesce(string_agg(x.digest, '' order by x.i) filter (x.n > 1 and x.i != r.{place}), '') proof
    from {name}{k - 1} r join {nodes}{k - 1} x on x.{key} = r.{key} and x.i // 3 = r.{place} // 3 group by r.rid, r.{key})""")
        return made

    steps = [
        f"""rows_ as materialized (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by source) n,
        dense_rank() over (order by source nulls first) - 1 tree from (
        select doc_id, source, {leaf("text")} leaf, row_number() over () rid,
            case when ({crc} # 4294967295) % 2 = 0 then {leaf("text")[:-1].replace("text", "replace(text, chr(10), '')")}) else {leaf("text")} end changed
        from documents))""".replace(f"({crc} # 4294967295)", f"xor({crc}, 4294967295)"),
        *tree("t", "select tree, i, n, leaf digest from rows_", "tree"),
        f"subroots as materialized (select tree, digest from t{levels})",
        *tree("s", "select 0 tree, tree i, (select count(*) from subroots) n, digest from subroots", "tree"),
        *climb("c", "select rid, tree, i, changed up, '' proof from rows_", "t", "tree", "i"),
        *climb("d", f"select rid, 0 tree, tree i, up, proof from c{levels}", "s", "tree", "i"),
    ]
    return f"""
with {", ".join(steps)}
select r.doc_id, r.leaf, b.digest subroot, s.digest root, sha256(d.proof) proof_sha256, d.up folded_root, d.up = s.digest verified
from rows_ r join subroots b using (tree) join d{levels} d using (rid), s{levels} s
"""


def mining_sql() -> str:
    return f"""
with whole as (
    select vec_id, case when vec_id % {mining.FLIP} = 0 then (label + 1) % {mining.LABELS} else label end label,
        list_transform(embedding, lambda x: floor({mining.SCALE} * x::double)) v
    from embeddings where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as materialized (
    select a.vec_id anchor_id, b.vec_id, a.label = b.label same, list_inner_product(a.v, b.v)::bigint score
    from whole a join whole b on a.vec_id % {mining.ANCHORS} = 0 and a.vec_id != b.vec_id and len(a.v) = len(b.v)
),
positives as (
    select anchor_id, vec_id positive_id, score positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {mining.POSITIVES}
)
select anchor_id, positive_id,
    (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
    vec_id negative_id, positive_score, score negative_score
from positives join scored using (anchor_id)
where not same and {mining.LEAST} * positive_score <= 100 * score and 100 * score <= {mining.MOST} * positive_score
qualify rank <= {mining.NEGATIVES}
"""


SQL = {
    "op12_merkle": merkle_sql(),
    "op13_negatives": mining_sql(),
    "op10_quality": quality_sql(),
    "op3_warc": warc_sql(),
    "op5_secrets": secrets_sql(),
    "op6_mixing": mixing_sql(),
    "op8_preferences": preferences_sql(),
}
