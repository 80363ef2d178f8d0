"""DuckDB SQL of the queries that SQL can express. Fingerprints with XXH64 (op4), tokenizers (op2, op5) and trained models (op9, op10) it can't."""

from __future__ import annotations

from .decontaminate import PERCENT, WINDOW
from .quality import HOST_LIMIT, MAX_REPEAT_PERCENT, MIN_WORDS, PRIOR_DOCUMENTS, RULES
from .secrets import BASE
from .secrets import RULES as SECRETS

_SPACES = r"[\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secret_scan() -> str:
    found = " union all ".join(
        f"""select rid, {n} number, {_text(r.kind)} kind, unnest(regexp_extract_all(text, {_text(r.pattern)}, 0)) found, unnest(regexp_extract_all(text, {_text(r.pattern)}, {r.group})) part,
        generate_subscripts(regexp_extract_all(text, {_text(r.pattern)}, 0), 1) place, string_split_regex(text, {_text(r.pattern)}) gaps, regexp_extract_all(text, {_text(r.pattern)}, 0) every, {r.least} least from docs"""
        for n, r in enumerate(SECRETS)
    )
    counts = ", ".join(f"count(*) filter (number = {n}) n_{r.kind}" for n, r in enumerate(BASE))
    spelled = "kind || ':' || start || ':' || (start + length(found))"
    return f"""with docs as (select row_number() over () rid, doc_id, coalesce(text, '') as text from documents),
    found as ({found}),
    spans as (select rid, number, kind, found, list_sum(list_transform(gaps[1:place], lambda x: length(x))) + coalesce(list_sum(list_transform(every[1:place - 1], lambda x: length(x))), 0) start
      from found where length(part) >= least),
    summed as (select rid, {counts}, coalesce(string_agg({spelled}, ',' order by start, number) filter (number < {len(BASE)}), '') base, string_agg({spelled}, ',' order by start, number) spans from spans group by rid)
    select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from docs left join summed using (rid)"""


def decontaminate() -> str:
    words = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
    return f"""with items as (select coalesce(item_id::varchar, '') item, {words} w from benchmark),
    sized as (select item, w, least(len(w), {WINDOW}) n from items where len(w) > 0),
    windows as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') x from (select item, n, w, unnest(range(1, len(w) - n + 2)) i from sized)),
    docs as (select row_number() over () rid, doc_id, {words} w from documents),
    met as (select rid, i, d.n, item from (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') x from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from docs, (select distinct n from sized))) d join windows using (n, x)),
    hit as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from met) group by rid),
    named as (select rid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct rid, item from met) group by rid)
    select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
      coalesce(n_hit, 0) > 0 and {PERCENT} * coalesce(n_hit, 0) >= len(w) contaminated from docs left join hit using (rid) left join named using (rid)"""


def chat_format() -> str:
    escaped = r"replace(replace(replace(said, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>')"
    role = "replace(replace(replace(role, '%', '%25'), '#', '%23'), chr(10), '%0A')"
    return rf"""with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') said from conversations
      union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, said) n from rows),
    whole as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || said || chr(10), '' order by n) turns, coalesce(string_agg(said, '' order by n) filter (role = 'assistant'), '') loss,
      sum(length('### ' || {role} || chr(10) || {escaped} || '</turn>' || chr(10))) formatted from placed group by conv_id)
    select conv_id::bigint conv_id, n_turns::bigint n_turns, sha256(turns) turns_sha256, length(loss)::bigint loss_chars, sha256(loss) loss_sha256, formatted::bigint formatted_chars from whole"""


def quality_rules() -> str:
    names = list(RULES)
    failed = ", ".join(f"sum(case when {rule} then 1 else 0 end) {name}_f" for name, rule in RULES.items())
    spread = ", ".join(f"greatest(1e-6, least(1 - 1e-6, sum({n}_f) / sum(n))) {n}_m, var_pop({n}_f / n) {n}_v" for n in names)
    strength = ", ".join(f"case when {n}_v > 0 then greatest({n}_m * (1 - {n}_m) / {n}_v - 1, {PRIOR_DOCUMENTS}) else {PRIOR_DOCUMENTS} end {n}_s" for n in names)
    worst = " or ".join(f"({n}_f + {n}_m * {n}_s) / (n + {n}_s) > {HOST_LIMIT}" for n in names)
    return rf"""with docs as (select row_number() over () rid, doc_id, source host, coalesce(text, '') as text from documents),
    worded as (select rid, doc_id, host, text, list_filter(string_split_regex(text, '{_SPACES}'), lambda x: x <> '') w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from docs),
    windows as (select rid, i, w[i:i + 2] x from (select rid, w, unnest(range(1, len(w) - 1)) i from worded)),
    again as (select rid, i from (select rid, i, count(*) over (partition by rid, x) n from windows) where n > 1),
    repeats as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from again) group by rid),
    m as (select rid, doc_id, host, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
      len(lines)::bigint n_lines, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words from worded left join repeats r using (rid)),
    hosts as (select host, count(*)::double n, {failed} from m group by host),
    spread as (select {spread} from hosts), prior as (select *, {strength} from spread),
    verdicts as (select host, {worst} rejected from hosts, prior),
    judged as (select m.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed, rejected from m join verdicts v on m.host is not distinct from v.host)
    select doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, rejected host_rejected, not base_failed and not rejected kept from judged"""


def warc() -> str:
    digit = lambda at: f"(instr('0123456789abcdef', substr(h, {at}, 1)) - 1)"
    five = f"(({digit('i * 5 // 4 + 1')} * 16 + {digit('i * 5 // 4 + 2')}) >> (3 - i * 5 % 4)) & 31"
    base32 = f"list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({five}) + 1, 1)), lambda a, b: a || b)"
    return f"""with hashed as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) h from pages),
    firsts as (select h, min(page_id) least from hashed group by h)
    select page_id, payload_bytes, {base32} payload_digest, case when least is null or page_id = least then 'response' else 'revisit' end record_type,
      case when least is null or page_id = least then null else least end refers_to from hashed join firsts using (h)"""


ORACLES = {"op1_secret_scan": secret_scan(), "op3_decontaminate": decontaminate(), "op6_chat_format": chat_format(), "op7_quality_rules": quality_rules(), "op8_warc": warc()}
