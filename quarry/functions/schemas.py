"""Schemas of the stored and returned records."""

DOCUMENT = "id string, title string, text string, metadata map<string,string>"
STORED = f"{DOCUMENT}, doc_ord long"
EVIDENCE = "struct<id:string,title:string,snippet:string,score:double>"
STEP = "struct<name:string,started_at:timestamp,completed_at:timestamp,duration_ms:double,details:string,status:string>"
TRACE = (
    "id string, started_at timestamp, completed_at timestamp, prompt string, answer string, "
    f"metrics map<string,double>, steps array<{STEP}>"
)
PROVIDER = (
    "kind string, name string, base_url string, models array<string>, running array<string>, "
    "version string, status string, error_message string"
)
