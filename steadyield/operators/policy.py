"""Dividend-policy texts: classifying titles and pages, latest results, and attaching them to candidates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadyield.functions.text import collapsed, compact, folded, let
from steadyield.operators.screener import latest_per

EVIDENCE_CHARS = 500


@dataclass(frozen=True)
class TitleWords:
    """What titles of disclosures are searched for, and the names of their categories."""

    policy: tuple[str, ...] = ("累進配当", "DOE", "株主還元方針", "配当方針", "配当政策", "株主還元")
    dividend: tuple[str, ...] = ("配当予想", "剰余金の配当", "増配", "減配", "復配", "無配", "記念配当", "配当", "株主還元", "経営計画", "説明会")
    cut: tuple[str, ...] = ("減配", "無配")
    rise: tuple[str, ...] = ("増配", "復配", "記念配当")
    forecast: tuple[str, ...] = ("配当予想",)
    plan: tuple[str, ...] = ("経営計画",)
    briefing: tuple[str, ...] = ("説明会",)
    names: dict[str, str] = field(default_factory=lambda: {"policy": "配当・株主還元方針", "cut": "減配・無配", "rise": "増配・復配", "forecast": "配当予想", "plan": "中期経営計画", "briefing": "決算説明会", "other": "配当・株主還元"})


@dataclass(frozen=True)
class PolicyTerms:
    """Terms that make a sentence worth judging, phrases that state a policy, and marks of doubt."""

    target: tuple[str, ...] = ("累進配当", "減配を行わない", "減配は行わない", "連続増配", "増配を継続")
    confirmed: tuple[str, ...] = (
        "累進配当(?:方針|政策)?(?:の)?(?:導入|採用|実施|継続)",
        "累進配当(?:方針|政策)?を(?:導入|採用|実施|継続)",
        "累進配当を(?:基本方針|基本|原則)(?:と|に)",
        "(?:配当方針|配当政策|株主還元方針)(?:は|として|に).*?累進配当",
        "原則として減配を行わない",
        "原則として減配は行わない",
        "連続増配",
        "増配を継続",
    )
    review: tuple[str, ...] = ("検討", "目指", "めざし", "志向", "予定", "可能性", "選択肢", "考えて", "考慮", "将来的", "今後", "導入しない", "採用しない", "実施しない", "継続しない", "廃止", "撤回", "終了", "取りやめ", "見直し")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def classify_titles(disclosures: DataFrame, words: TitleWords = TitleWords(), title: str = "title", as_given: bool = False) -> DataFrame:
    """Adds category, is_policy_candidate and matched keywords; titles without a keyword go. Titles are folded to their compatibility form with single blanks, unless as_given says that they are."""
    if not as_given:
        disclosures = disclosures.withColumn(title, collapsed(folded(title)))
    text, upper = F.col(title), F.upper(title)
    keywords = tuple(dict.fromkeys(words.policy + words.dividend))
    matched = F.array_compact(F.array(*(F.when(upper.contains(k.upper()), F.lit(k)) for k in words.policy + words.dividend)))
    policy = has_any(upper, tuple(k.upper() for k in words.policy))
    plan, briefing = has_any(text, words.plan), has_any(text, words.briefing)
    category = F.when(policy, words.names["policy"]).when(has_any(text, words.cut), words.names["cut"]).when(has_any(text, words.rise), words.names["rise"]).when(has_any(text, words.forecast), words.names["forecast"]).when(plan, words.names["plan"]).when(briefing, words.names["briefing"]).otherwise(words.names["other"])
    return disclosures.filter(has_any(upper, tuple(k.upper() for k in keywords))).withColumns({"category": category, "is_policy_candidate": policy | plan | briefing, "matched_keywords": matched})


# a sentence ends with its mark or at a line's end
SENTENCE = r"([^。！？!?\r\n]*[。！？!?]|[^。！？!?\r\n]+)"


def evidence_text(sentence: Column, phrase: Column, limit: int = EVIDENCE_CHARS) -> Column:
    """The sentence, or so many characters around where the phrase stands, ends marked."""
    at = F.greatest(F.instr(compact(sentence), compact(phrase)) - 1, F.lit(0))
    start = F.greatest(F.lit(0), F.least(at, F.length(sentence) - 1) - limit // 2)
    piece = sentence.substr(start.cast("int") + 1, F.lit(limit))
    head = F.when(start > 0, F.concat(F.lit("…"), piece.substr(F.lit(2), F.lit(limit)))).otherwise(piece)
    tail = F.when(start + limit < F.length(sentence), F.concat(head.substr(F.lit(1), F.lit(limit - 1)), F.lit("…"))).otherwise(head)
    return F.when(F.length(sentence) <= limit, sentence).otherwise(tail)


def classify_pages(pages: DataFrame, terms: PolicyTerms = PolicyTerms(), key: str = "doc_id") -> DataFrame:
    """For each document of rows (key, page_no, text): confirmed, manual_review or not_confirmed, with the first sentence that says so. Pages are folded to their compatibility form first.

    A sentence that states a policy but carries a mark of doubt is for review;
    a clear sentence elsewhere outweighs it.
    """
    def judged(raw: Column, plain: Column, k: Column) -> Column:
        stated = F.coalesce(*(F.nullif(F.regexp_extract(plain, p, 0), F.lit("")) for p in terms.confirmed))
        term = F.coalesce(*(F.when(plain.contains(t), F.lit(t)) for t in terms.target))
        told = lambda said: F.struct(k.alias("sentence_no"), collapsed(raw).alias("sentence"), F.coalesce(said, term).alias("phrase"), (said.isNotNull() & ~has_any(plain, terms.review)).alias("sure"))
        return F.when(has_any(plain, terms.target), let(stated, told))

    # worked out within lambdas, once a sentence: as columns, filters would be pushed in front and have it done again for each word
    told = F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), 1), lambda raw, k: let(compact(raw), lambda plain: judged(raw, plain, k)))
    found = pages.withColumn("text", folded("text")).select(key, "page_no", F.explode_outer(told).alias("told")).filter("told is not null").select(key, "page_no", "told.*")
    first = latest_per(found, key, F.desc("sure"), F.asc("page_no"), F.asc("sentence_no"))
    told = first.select(key, F.when(F.col("sure"), "confirmed").otherwise("manual_review").alias("classification"), "page_no", F.col("phrase").alias("matched_phrase"), F.col("sentence").alias("evidence"))
    every = pages.select(key).distinct()
    return every.join(told, key, "left").withColumn("classification", F.coalesce("classification", F.lit("not_confirmed")))


def latest_results(results: DataFrame) -> DataFrame:
    """Latest completed result of each security: by date, time (unknown last) and id."""
    return latest_per(results.filter("status = 'completed'"), "security_code", F.desc("published_date"), F.desc_nulls_last("published_time"), F.desc("disclosure_id"))


def latest_filings(filings: DataFrame) -> DataFrame:
    """Latest annual filing of each security; one whose submission time is unknown counts as newest of its period."""
    return latest_per(filings, "security_code", F.desc_nulls_last("fiscal_period_end"), F.desc_nulls_first("submitted_at"), F.desc("doc_id"))


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """Latest alert of each security; of equal times the first in the list."""
    return latest_per(alerts, "security_code", F.desc("published_date"), F.desc_nulls_last("published_time"), F.asc("row_no"))


def attach_results(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Adds the latest result where the candidate names no document or the same one; a candidate without one takes over date, title and address."""
    r = latest_results(results).select("security_code", F.col("published_date").alias("r_date"), F.col("title").alias("r_title"), F.col("url").alias("r_url"), "classification", "evidence")
    open_ = F.col("url").isNull() | (F.trim("url") == "")
    fits = F.col("r_url").isNotNull() & (open_ | (F.col("url") == F.col("r_url")))
    taken = lambda own, other: F.when(open_ & fits, F.col(other)).otherwise(F.col(own))
    out = candidates.join(r, "security_code", "left")
    return out.select(*[c for c in candidates.columns if c not in ("published_date", "title", "url")], taken("published_date", "r_date").alias("published_date"), taken("title", "r_title").alias("title"), taken("url", "r_url").alias("url"), F.when(fits, F.col("classification")).alias("classification"), F.when(fits, F.col("evidence")).alias("evidence"))


def attach_filing_results(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Adds the latest annual-report result, whatever document the candidate names."""
    newest = latest_per(results.filter("status = 'completed'"), "security_code", F.desc("submitted_date"), F.desc("doc_id"))
    return candidates.join(newest.select("security_code", F.col("classification").alias("report_classification"), F.col("doc_id").alias("report_doc_id")), "security_code", "left")


def attach_alerts(candidates: DataFrame, policies: DataFrame, alerts: DataFrame, warn_on: tuple[str, ...]) -> DataFrame:
    """Adds the latest policy title and the latest dividend alert, with a warning for alerts of bad categories."""
    p = latest_per(policies, "security_code", F.desc("published_date"), F.desc_nulls_last("published_time"), F.desc("disclosure_id")).select("security_code", F.col("title").alias("policy_title"))
    a = latest_alerts(alerts).select("security_code", F.col("category").alias("alert_category"), F.col("published_date").alias("alert_date"))
    return candidates.join(p, "security_code", "left").join(a, "security_code", "left").withColumn("is_warned", F.coalesce(F.col("alert_category").isin(*warn_on), F.lit(False)))


def evidence(results: DataFrame, reports: DataFrame) -> DataFrame:
    """The best text evidence of each security from both kinds of document: confirmed first, then newest."""
    both = results.filter("status = 'completed' and classification <> 'not_confirmed'").select("security_code", F.lit("disclosure").alias("source"), F.col("disclosure_id").cast("string").alias("document_id"), "published_date", "title", "url", "classification", "evidence")
    filed = reports.filter("status = 'completed' and classification <> 'not_confirmed'").select("security_code", F.lit("report").alias("source"), F.col("doc_id").cast("string").alias("document_id"), F.col("submitted_date").alias("published_date"), F.lit(None).cast("string").alias("title"), "url", "classification", "evidence")
    every = both.unionByName(filed).withColumn("is_confirmed", F.col("classification") == "confirmed")
    best = latest_per(every, "security_code", F.desc("is_confirmed"), F.desc("published_date"), F.desc("document_id"))
    return best.orderBy(F.desc("is_confirmed"), F.desc("published_date"), "security_code")


def overwrite_evidence(candidates: DataFrame, proof: DataFrame) -> DataFrame:
    """Puts the evidence document's values in place of those of its own kind: disclosure or report columns."""
    e = proof.select("security_code", F.col("source").alias("e_source"), F.col("classification").alias("e_class"), F.col("document_id").alias("e_id"))
    pick = lambda kind, own, other: F.when(F.col("e_source") == kind, F.col(other)).otherwise(F.col(own)).alias(own)
    kept = [c for c in candidates.columns if c not in ("classification", "document_id", "report_classification", "report_doc_id")]
    return candidates.join(e, "security_code", "left").select(*kept, pick("disclosure", "classification", "e_class"), pick("disclosure", "document_id", "e_id"), pick("report", "report_classification", "e_class"), pick("report", "report_doc_id", "e_id"))


def analysis_state(targets: DataFrame, results: DataFrame, version: str, max_attempts: int = 3, retried: tuple[str, ...] | None = None) -> DataFrame:
    """What to do with each target: new, version_changed, retry, exhausted or done. retried names the failed states; None means any but completed."""
    old = results.select("disclosure_id", "status", "analyzer_version", "attempts")
    failed = F.col("status") != "completed" if retried is None else F.col("status").isin(*retried)
    state = F.when(F.col("status").isNull(), "new").when(~F.col("analyzer_version").eqNullSafe(version), "version_changed").when(failed & (F.col("attempts") < max_attempts), "retry").when(failed, "exhausted").otherwise("done")
    return targets.join(old, "disclosure_id", "left").withColumn("state", state)


def analysis_batch(states: DataFrame, limit: int = 100) -> DataFrame:
    """The targets of one run in order; what is beyond it waits."""
    return states.filter(F.col("state").isin("new", "version_changed", "retry")).orderBy(F.desc("published_date"), "disclosure_id").limit(limit)


def run_counts(states: DataFrame, limit: int = 100) -> DataFrame:
    """One row: how many targets a run takes, defers beyond its limit, skips as done and gives up on."""
    open_ = F.count_if(F.col("state").isin("new", "version_changed", "retry"))
    counted = states.agg(open_.alias("open"), *(F.count_if(F.col("state") == s).alias(name) for s, name in (("done", "skipped"), ("exhausted", "exhausted"))))
    return counted.select(F.least("open", F.lit(limit).cast("long")).alias("taken"), F.greatest(F.col("open") - limit, F.lit(0).cast("long")).alias("deferred"), "skipped", "exhausted")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").pivot("classification", ["confirmed", "manual_review", "not_confirmed"]).count().na.fill(0)


def report_rows(disclosures: DataFrame, results: DataFrame) -> DataFrame:
    """Disclosures with the state of their analysis; its findings only where it is complete."""
    r = results.select("disclosure_id", "status", "classification", "evidence")
    shown = lambda c: F.when(~F.col("is_policy_candidate"), "not_applicable").when(F.col("status").isNull(), "not_analysed").when(F.col("status") != "completed", F.col("status")).otherwise(F.col(c))
    return disclosures.join(r, "disclosure_id", "left").withColumns({"analysis": shown("classification"), "analysis_evidence": F.when((F.col("status") == "completed") & F.col("is_policy_candidate"), F.col("evidence"))}).drop("status", "classification", "evidence")


def policy_report_rows(disclosures: DataFrame, results: DataFrame, updated_at: str, note: str) -> DataFrame:
    """The latest policy disclosure of each security, by date, time and id as text, with its analysis in five cells.

    Cells: state, classification, phrase, evidence and its page. The state is
    not_analysed without a result; the other cells are filled for completed
    results only. Securities without a policy disclosure have no row.
    """
    newest = latest_per(disclosures.filter("is_policy_candidate"), "security_code", F.desc("published_date"), F.desc_nulls_last("published_time"), F.desc(F.col("disclosure_id").cast("string")))
    found = {"classification": "body_classification", "matched_phrase": "body_phrase", "evidence": "body_evidence", "page_no": "body_page"}
    r = results.select("disclosure_id", "status", *(F.when(F.col("status") == "completed", F.col(c)).alias(name) for c, name in found.items()))
    out = newest.drop("is_policy_candidate", "status", *found.values()).join(r, "disclosure_id", "left")
    return out.withColumns({"body_state": F.coalesce("status", F.lit("not_analysed")), "updated_at": F.lit(updated_at), "note": F.lit(note)}).drop("status")
