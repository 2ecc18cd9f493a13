"""Schemas of the records that are read."""

REQUEST = (
    "id string, transaction struct<amount:double,installments:double,requested_at:string>, "
    "customer struct<avg_amount:double,tx_count_24h:double,known_merchants:array<string>>, "
    "merchant struct<id:string,mcc:string,avg_amount:double>, "
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:double>, "
    "last_transaction struct<timestamp:string,km_from_current:double>"
)
REFERENCE = "vector array<double>, label string"
REPORT = (
    "metadata struct<timestamp:string,sha:string,short_sha:string,run_id:string,run_url:string,image:string,report_kind:string,"
    "benchmark_k6_mode:string,html_report:string>, "
    "result struct<p99:string,expected:struct<total:bigint,fraud_count:bigint,legit_count:bigint>,"
    "scoring:struct<failure_rate:string,final_score:double,breakdown:struct<http_errors:bigint,false_positive_detections:bigint,"
    "false_negative_detections:bigint,true_positive_detections:bigint,true_negative_detections:bigint>>>"
)
COMPARISON = (
    "participant string, p99 string, final_score double, false_positive_detections bigint, false_negative_detections bigint, http_errors bigint"
)
OFFICIAL_RESULT = "`test-results` struct<p99:string,scoring:struct<final_score:double,failure_rate:string>>, `repo-url` string"
