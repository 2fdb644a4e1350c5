"""Schemas of the landed records, as DDL strings."""

_VERSION = "struct<package_id:string,version_code:string,date_issued:string>"

METADATA_DDL = (
    "bill_id string, congress bigint, bill_type string, bill_number bigint, title string, short_title string, sponsor string,"
    "introduced_date string, latest_action string, policy_area string, subjects array<string>, summary_text string, centrality_score double,"
    "match_locations map<string,array<string>>, tier string, stream string, topic string,"
    f"versions_available array<{_VERSION}>, canonical_version {_VERSION},"
    "actions array<struct<actionCode:string,actionDate:string,text:string,type:string,"
    "committees:array<struct<name:string,systemCode:string,url:string>>,sourceSystem:struct<code:bigint,name:string>>>,"
    "cosponsors array<struct<bioguideId:string,firstName:string,lastName:string,fullName:string,party:string,state:string,"
    "sponsorshipDate:string,url:string,district:bigint,isOriginalCosponsor:boolean>>"
)
PROVENANCE_DDL = (
    "bill_id string, criteria_version string, canonical_package_id string, sources map<string,string>,"
    "files map<string,boolean>, fetched_at string"
)
HIT_DDL = "packageId string, dateIssued string, title string"
CANDIDATE_DDL = (
    "bill_id string, congress bigint, bill_type string, bill_number bigint, topic string,"
    "versions array<struct<package_id:string,version_code:string,date_issued:string,title:string>>, govinfo_titles array<string>,"
    "title string, short_title string, sponsor string, introduced_date string, latest_action string, policy_area string,"
    "subjects array<string>, summary_text string, centrality_score double, match_locations map<string,array<string>>,"
    "has_anchor boolean, proposed_tier string, reconciliation_error string"
)
CRITERIA_DDL = (
    "query_id string, category string, question string, answer_must_contain array<string>, answer_must_not_contain array<string>,"
    "answer_must_cite array<string>, bill_id_min array<string>, bill_id_set_full array<string>, abstain boolean"
)
TRACE_DDL = (
    "ts string, message_chars bigint, history_turns bigint, total_ms double, first_token_ms double,"
    "iterations array<struct<i:bigint,llm_ms:double,tool_ms:double,gap_ms:double,tools:array<string>>>,"
    "tool_calls array<struct<name:string,ms:double>>, error string"
)
CALL_DDL = "event_id bigint, user_id bigint, email string, input_tokens bigint, output_tokens bigint, ts timestamp"
