"""Queries of the training-data problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydrift.llm import groups, leakage, mixing, pii, sampling, survivors
from skydrift.plans.registry import Registry
from skydrift.runtime import table

R = Registry()


def _key(c: str) -> str:
    rx = r"(?i)scramble\D*?0*(\d+)\D+?roi\D*?0*(\d+)\D+?candidate\D*?0*(\d+)"
    parts = " || '/' || ".join(f"regexp_extract({c}, '{rx}', {i})" for i in (1, 2, 3))
    return f"case when regexp_matches({c}, '{rx}') then {parts} end"


#: Closure by label propagation over (track, list) links, until nothing changes.
_GROUPS = f"""
with recursive t as (select distinct _candidate_id id, {_key('_candidate_id')} k from tracks),
e as (
  select {_key('candidate_a')} a, {_key('candidate_b')} b from track_matches where is_match
  union all
  select k, 'l' || list_no from (select list_no, {_key('m')} k
    from (select list_no, unnest(list_append(members, representative)) m from duplicate_groups))),
f as (select a, b from e where a in (select k from t) and (b in (select k from t) or b like 'l%') and a <> b),
s as (select a, b from f union select b, a from f),
reach(n, r) as (select distinct a, a from s union select s.b, reach.r from reach join s on s.a = reach.n),
g as (select n, min(r) c from reach group by n),
m as (select id, c from t join g on g.n = t.k),
grouped as (select id _candidate_id, min(id) over (partition by c) group_id, count(*) over (partition by c) n from m)
"""


@R.add("p1_found", _GROUPS + "select _candidate_id, group_id from grouped where n > 1")
def p1_found(spark, d):
    return groups.track_groups(table(spark, d, "tracks"), table(spark, d, "track_matches"), table(spark, d, "duplicate_groups"))


def _survived(spark, d):
    return survivors.surviving_tracks(table(spark, d, "tracks"), p1_found(spark, d))


_SURVIVORS = (
    _GROUPS
    + """,
v as (select * from (select *, row_number() over (partition by _candidate_id order by loaded_at desc) k from tracks) where k = 1),
x as (
  select group_id, v._candidate_id id,
         list_sum(list_transform(points, lambda p: case when p.sigma is null or isnan(p.sigma) then 0 else p.sigma end)) s,
         average_velocity_deg_per_year av, detection_band_photons dp, detected_bands db
  from v join grouped g on g._candidate_id = v._candidate_id where n > 1),
y as (
  select group_id, 'representative' field_name, id, s from x
  union all select group_id, 'average_velocity_deg_per_year', id, s from x where av is not null and not isnan(av) and av >= 0
  union all select group_id, 'detection_band_photons', id, s from x where dp is not null and dp >= 0
  union all select group_id, 'detected_bands', id, s from x where len(db) > 0)
"""
)


@R.add(
    "p2_found",
    _SURVIVORS
    + """select group_id, field_name, id _candidate_id
from (select *, row_number() over (partition by group_id, field_name order by s desc, id) k from y) where k = 1""",
)
def p2_found(spark, d):
    return survivors.survivor_sources(_survived(spark, d))


@R.add(
    "p2_survivors",
    _SURVIVORS
    + """,
z as (select group_id, field_name, id from (select *, row_number() over (partition by group_id, field_name order by s desc, id) k from y) where k = 1)
select r.group_id, r.id representative, xa.av average_velocity_deg_per_year, xd.dp::double detection_band_photons, array_to_string(xb.db, '|') detected_bands
from z r left join z a on a.group_id = r.group_id and a.field_name = 'average_velocity_deg_per_year' left join x xa on xa.id = a.id
left join z d on d.group_id = r.group_id and d.field_name = 'detection_band_photons' left join x xd on xd.id = d.id
left join z b on b.group_id = r.group_id and b.field_name = 'detected_bands' left join x xb on xb.id = b.id
where r.field_name = 'representative'""",
)
def p2_survivors(spark, d):
    v, n, b = survivors.FIELDS
    return _survived(spark, d).select("group_id", "representative", v, F.col(n).cast("double").alias(n), F.array_join(b, "|").alias(b))


_STRATA = ", ".join(f"('{q}', '{sampling.threshold(r)}')" for q, r in sampling.PHOTON_RATES.by_stratum.items())


@R.add(
    "p3_sample",
    f"""
with strata(quarter, bound) as (values {_STRATA}),
k as (select distinct run_id & 4294967295 run_id, event_id & 4294967295 event_id from photons where run_id is not null and event_id is not null)
select run_id, event_id from k left join strata on (run_id // {sampling.QUARTER_SECONDS})::varchar = quarter
where md5('{sampling.PHOTON_SALT}:' || run_id || ':' || event_id)[1:{sampling.DIGITS}] < coalesce(bound, '{sampling.threshold(sampling.PHOTON_RATES.default)}')
""",
)
def p3_sample(spark, d):
    return sampling.photon_sample(table(spark, d, "photons"))


def _plain(text: str) -> str:
    """Small letters of one choice of code points, without mark-up."""
    q = lambda t: t.replace("'", "''")
    wide, thin = "".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94))
    bare = f"regexp_replace(regexp_replace({text}, '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '[*`~]', '', 'g')"
    return f"lower(strip_accents(replace(replace(translate({bare}, '{q(wide)}', '{q(thin)}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')))"


#: Windows of 13 item words and of 10 to 13 document words, compared without the gaps between words
#: (thousands may be written as one number), documents also with words joined at line ends.
_LEAKS = rf"""
with i0 as (select distinct item_id, regexp_extract_all({_plain('text')}, '[\p{{L}}\p{{N}}]+') ws from eval_items where text is not null),
i1 as (select item_id, array_to_string(ws[k:k + 12], '') s from (select item_id, ws, unnest(generate_series(1, len(ws) - 12)) k from i0)),
d0 as (select doc_id, {_plain('text')} t from documents where text is not null),
d1 as (select doc_id, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') ws from d0
       union all select doc_id, regexp_extract_all(regexp_replace(t, '(\p{{L}})-[ \t]*\n[ \t>]*(\p{{L}})', '\1\2', 'g'), '[\p{{L}}\p{{N}}]+') from d0 where regexp_matches(t, '\p{{L}}-[ \t]*\n')),
d2 as (select doc_id, ws, unnest(generate_series(1, len(ws))) k from d1),
d3 as (select doc_id, array_to_string(ws[k:k + n - 1], '') s from d2, (values (10), (11), (12), (13)) v(n) where k + n - 1 <= len(ws))
select distinct doc_id, item_id from d3 join i1 using (s)
"""


@R.add("p7_found", _LEAKS)
def p7_found(spark, d):
    return p7_passages(spark, d).where("edits = 0").select("doc_id", "item_id")


@R.add("p7_passages")
def p7_passages(spark, d):
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


#: Token counts of the documents of a folder, made once per program and kept as long as their table is there.
_COUNTED: dict[tuple[str, str], DataFrame] = {}


def _mixture(spark, d):
    docs, key = table(spark, d, "documents"), (spark.sparkContext.applicationId, d)
    have = _COUNTED.get(key)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if have is None or not path(have._durable_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(have._durable_path)):
        have = _COUNTED[key] = mixing.counted_documents(docs)
    return mixing.mixture(docs, table(spark, d, "mix_targets"), counted=have)


@R.add("p8_mixture")
def p8_mixture(spark, d):
    return _mixture(spark, d)[0]


@R.add("p8_shares")
def p8_shares(spark, d):
    return _mixture(spark, d)[1]


@R.add("p8_kept", "select source, true cap_kept, true target_met, true total_met from mix_targets")
def p8_kept(spark, d):
    """Per source: no document more often than allowed, tokens within one document of what is wanted; and the total, half the corpus's tokens, met as closely."""
    copies, shares = _mixture(spark, d)
    caps = table(spark, d, "mix_targets").select("source", "max_repeats")
    longest = copies.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    corpus = _COUNTED[spark.sparkContext.applicationId, d].agg(F.sum("n_tokens").alias("all"))
    total = shares.agg(F.sum("tokens").alias("mixed"), F.sum("target_tokens").alias("wanted"))
    far = F.abs(F.col("tokens") - F.col("target_tokens")) <= F.coalesce("longest", F.lit(0))
    met = (F.abs(F.col("wanted") * 2 - F.col("all")) < 1e-3 * F.col("all")) & (F.abs(F.col("mixed") * 2 - F.col("all")) < 1e-3 * F.col("all") + 1e5)
    j = shares.join(caps, "source").join(longest, "source", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(corpus))  # one row each
    return j.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"), far.alias("target_met"), met.alias("total_met"))


@R.add("p9_found")
def p9_found(spark, d):
    return pii.find_pii(table(spark, d, "documents"), table(spark, d, "observers"))


@R.add("p9_redacted")
def p9_redacted(spark, d):
    return pii.redact_pii(table(spark, d, "documents"), table(spark, d, "observers"))
