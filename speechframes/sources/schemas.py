"""Schemas of the message tables. Enums are strings; absent scalars are null or ''."""

from __future__ import annotations

HEADERS = "array<struct<key:string,value:binary>>"
WORD = "struct<start_s:double,end_s:double,text:string>"
SEGMENT = f"struct<start_s:double,end_s:double,text:string,speaker:string,words:array<{WORD}>>"
AUDIO_CHUNKS = f"session_id string, seq long, t0_ns long, sample_rate int, pcm16_le binary, lang string, bff_origin_uri string, tenant_id string, headers {HEADERS}, arrived timestamp"
ASR_EVENTS = "session_id string, start_s double, end_s double, text string, type string, lang string, speaker string, provider_profile_id string, serving_instance_id string"
TURNS = "session_id string, turn_ord long, s_ms long, e_ms long, speaker string, confidence float"
REFINED_EVENTS = f"session_id string, tenant_id string, track_id string, start_s double, end_s double, text string, supersedes_seq array<bigint>, lang string, window_sec double, slice_index int, flush_reason string, segments array<{SEGMENT}>, created_at_ns long, refinement_model string"
RECORDINGS = f"session_id string, tenant_id string, recording_url string, duration_s double, sample_rate int, lang string, created_at_ns long, headers {HEADERS}"
TRANSCRIPTS = f"session_id string, tenant_id string, recording_url string, lang string, duration_s float, segments array<{SEGMENT}>, full_text string, created_at_ns long, track_id string"
MANIFEST = "speaker_id string, label string, updated_at string, samples array<struct<url:string,sample_id:string,sha256:string,duration_s:double>>"
SPEAKER_INDEX = "tenant_id string, speakers array<struct<speaker_id:string,label:string,updated_at:string>>"
GALLERY = "tenant_id string, label string, embedding array<double>"
