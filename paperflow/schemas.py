"""Spark types of the stored tables and nested documents."""

from __future__ import annotations

from . import catalog as C

CHANGE = "struct<value:string,field_status:string>"
SOURCE = ("struct<page_ref:string,row:string,column:string,bbox:array<double>,"
          "readings:array<struct<page_ref:string,raw_text:string,value:string,field_status:string,confidence:double>>,"
          "normalization:struct<from:string,to:string,factor:double,weeks:int,days:int>,"
          "checkboxes:array<struct<label:string,state:string,ink:double>>>")
FIELD_VALUE = (f"struct<raw_text:string,value:string,unit:string,confidence:double,field_status:string,"
               f"validation_flags:array<string>,source:{SOURCE},verification:struct<state:string,by:string,at:string>,"
               f"corrections:array<struct<at:string,by:string,action:string,previous:{CHANGE},new:{CHANGE}>>>")
FIELD_MAP = f"map<string,{FIELD_VALUE}>"

DRAFT = (
    "schema_version string, layout_id string, notes string, "
    "extraction struct<extractor:string,extractor_version:string,processed_at:string>, "
    "pages array<struct<page_ref:string,section:string,section_source:string,section_confidence:string,read:boolean,"
    "review_reason:string,retake_reason:string,warnings:array<string>,"
    "grid:struct<found:boolean,visit_columns:array<string>,unread_columns:array<string>,blank_columns:array<string>>>>, "
    "pii_detected array<struct<page_ref:string,category:string,action:string>>, "
    f"document_fields {FIELD_MAP}, encounters array<struct<encounter_type:string,slot:string,fields:{FIELD_MAP}>>, "
    f"extended struct<catalog_version:string,patient:{FIELD_MAP},pregnancy:{FIELD_MAP},"
    f"previous_deliveries:array<struct<column:int,fields:{FIELD_MAP}>>,visit_labs:array<struct<slot:string,fields:{FIELD_MAP}>>,"
    f"delivery:{FIELD_MAP},newborns:array<struct<index:int,fields:{FIELD_MAP}>>,"
    f"newborn_consultations:array<struct<period:string,fields:{FIELD_MAP}>>>"
)

WEBHOOK = ("struct<object:string,entry:array<struct<id:string,changes:array<struct<field:string,value:struct<"
           "metadata:struct<phone_number_id:string>,"
           "messages:array<struct<id:string,`from`:string,timestamp:string,type:string,"
           "image:struct<id:string,mime_type:string,sha256:string>,context:struct<id:string>,"
           "errors:array<struct<code:string>>>>,"
           "statuses:array<struct<id:string,status:string,errors:array<struct<code:string>>>>>>>>>>")

# One DDL per state table; times are timestamps, nested values native.
STATE = {
    "facilities": "facility_id string, name string",
    "senders": "sender_id string, facility_id string, label string, channel string",
    "documents": ("document_id string, sender_id string, facility_id string, status string, grouping_status string, "
                  "created_at timestamp, last_page_at timestamp, updated_at timestamp, revision int, "
                  "selection struct<choice:string,patient_id:string,by:string,at:timestamp>, "
                  "registration struct<patient_id:string,patient_created:boolean,registered_by:string,registered_at:timestamp>, "
                  "failure_reason string"),
    "capture_groups": "group_id string, sender_id string, document_id string",
    "pages": ("page_id string, document_id string, source_message_id string, sender_id string, media_ref string, "
              "media_sha256 string, position int, received_at timestamp, replaced_by string, section_hint string"),
    "retake_requests": ("request_id string, document_id string, page_id string, sender_id string, facility_id string, "
                        "status string, requested_by string, requested_at timestamp, request_message_id long, "
                        "replacement_page_id string, replacement_message_id string, closed_by string, closed_at timestamp"),
    "patients": ("patient_id string, facility_id string, registry_file_number string, midwife_patient_code string, "
                 "flags array<string>, created_at timestamp, created_by string"),
    "visits": (f"visit_id string, patient_id string, encounter_type string, visit_date date, slot string, fields {FIELD_MAP}, "
               f"source_documents array<string>, history array<struct<at:timestamp,by:string,document_id:string,"
               f"previous:{FIELD_MAP},selected_fields:array<string>>>, created_at timestamp, updated_at timestamp, "
               f"registered_by string"),
    "messages": "id long, sender_id string, direction string, body string, media_ref string, created_at timestamp",
    "events": "id long, document_id string, type string, actor string, at timestamp, detail string",
    "whatsapp_inbound": ("inbound_id string, wa_message_id string, message_type string, sender_id string, media_id string, "
                         "mime_type string, media_sha256 string, context_message_id string, sent_at timestamp, "
                         "received_at timestamp, status string, attempts int, next_attempt_at timestamp, last_error string, "
                         "page_id string, updated_at timestamp"),
    "whatsapp_outbound": ("message_id long, sender_id string, status string, attempts int, next_attempt_at timestamp, "
                          "wa_message_id string, last_error string, updated_at timestamp"),
    "central_sync_log": ("sync_id string, document_id string, patient_id string, ack_id string, target string, status string, "
                         "synced_at timestamp"),
}

REGISTRY = ", ".join(f"`{h}` {'string' if h == 'id' else 'double'}" for h in C.EXPORT_HEADERS)

TRUTH = ("page int, patient int, split string, layout string, expected_section string, supported boolean, slot string, "
         "section string, item string, field string, state string, text string, canonical string, choice string, "
         "sha256 string, accept array<string>")

OCR_LINE = ("document_id string, page_ref string, line_no int, text string, confidence double, "
            "x0 double, y0 double, x1 double, y1 double")
