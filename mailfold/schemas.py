"""Declared schemas: nothing in the library infers types."""

RAW_MESSAGES = """
  id STRING, thread_id STRING, internal_date STRING, account STRING, owner STRING, mailbox_category STRING,
  headers ARRAY<STRUCT<name: STRING, value: STRING>>,
  parts ARRAY<STRUCT<path: STRING, mime_type: STRING, data: STRING>>
"""

MESSAGES = """
  owner STRING, account STRING, message_id STRING, thread_id STRING, subject STRING, sender STRING,
  body STRING, internal_ms BIGINT, msg_date DATE
"""

MODEL_OUTPUTS = "owner STRING, message_id STRING, raw_text STRING"

EVENTS = """
  owner STRING, account STRING, message_id STRING, thread_id STRING, subject STRING, kind STRING,
  category STRING, company STRING, role STRING, external_id STRING, company_domain STRING,
  is_confirmation BOOLEAN, is_fast_apply BOOLEAN, detected_by STRING, classifier_code STRING,
  internal_ms BIGINT, msg_date DATE
"""

REF = "STRUCT<message_id: STRING, category: STRING, date: STRING, fast_apply: BOOLEAN>"

APPLICATIONS = f"""
  owner STRING, app_id STRING, company STRING, role STRING, status STRING, interview_step STRING,
  reached_interview BOOLEAN, date_applied DATE, last_activity DATE, last_activity_ts BIGINT,
  job_url STRING, notes STRING, notes_source STRING, external_id STRING, edited BOOLEAN,
  detected_by STRING, company_domain STRING, awaiting_application BOOLEAN, fast_apply BOOLEAN,
  confirmed BOOLEAN, source STRING, thread_id STRING, account STRING, first_ms BIGINT,
  created_at TIMESTAMP, updated_at TIMESTAMP
"""

# One row per tracked message of an application; nested only where a report needs it.
REFS = """
  owner STRING, app_id STRING, position BIGINT, message_id STRING, category STRING, date STRING,
  fast_apply BOOLEAN
"""

LEDGER = "owner STRING, message_id STRING, thread_id STRING, classified_as STRING, synced_at TIMESTAMP"

# The employer component of a name or domain of an owner.
BLOCKS = "owner STRING, node STRING, component STRING"

QUARANTINE = f"{RAW_MESSAGES}, _corrupt_record STRING, arrival STRING"

EDITS = f"owner STRING, app_id STRING, set_fields MAP<STRING, STRING>, emails ARRAY<{REF}>"
