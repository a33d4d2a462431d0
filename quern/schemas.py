"""Schemas of the content collections and chat tables, declared and never inferred."""

from __future__ import annotations

_ID = "id STRING NOT NULL, createdAt TIMESTAMP NOT NULL, updatedAt TIMESTAMP NOT NULL"
_PAGE = "title STRING NOT NULL, slug STRING NOT NULL, description STRING, lang STRING NOT NULL, publishedAt TIMESTAMP NOT NULL, heroImage STRING NOT NULL, content STRING NOT NULL, _status STRING"

#: Collection and column names. Rich text is kept as JSON text.
COLLECTIONS = {
    "news": f"{_ID}, tag STRING NOT NULL, {_PAGE}",
    "learning_materials": f"{_ID}, {_PAGE}",
    "research_labs": f"{_ID}, {_PAGE}",
    "courses": f"{_ID}, title STRING NOT NULL, slug STRING NOT NULL, description STRING NOT NULL, lang STRING NOT NULL, tag STRING NOT NULL, duration STRING NOT NULL, modules INT NOT NULL, heroImage STRING NOT NULL, content STRING NOT NULL, _status STRING",
    "solutions": f"{_ID}, title STRING NOT NULL, shortDescription STRING NOT NULL, lang STRING NOT NULL, backgroundImage STRING NOT NULL, content STRING NOT NULL, _status STRING",
    "members": f"{_ID}, name STRING NOT NULL, avatar STRING NOT NULL, role STRING, school STRING, rank INT NOT NULL",
    "publications": f"{_ID}, title STRING NOT NULL, link STRING NOT NULL, year INT NOT NULL, authors STRING NOT NULL, abstract STRING NOT NULL, background STRING",
    "upcoming_events": f"{_ID}, title STRING NOT NULL, time TIMESTAMP NOT NULL",
    "cyber_clinic_videos": f"{_ID}, title STRING NOT NULL, slug STRING NOT NULL, publishedAt TIMESTAMP NOT NULL, coverImage STRING NOT NULL, source STRING NOT NULL, videoFile STRING, externalUrl STRING",
    "media": f"{_ID}, caption STRING NOT NULL, url STRING, thumbnailURL STRING, filename STRING, mimeType STRING, filesize DOUBLE, width DOUBLE, height DOUBLE, focalX DOUBLE, focalY DOUBLE",
    "users": f"{_ID}, email STRING NOT NULL, loginAttempts INT, lockUntil TIMESTAMP, sessions ARRAY<STRUCT<id: STRING, createdAt: TIMESTAMP, expiresAt: TIMESTAMP>>",
}

#: Chat tables; ``decistion_type`` is spelled as its producers spell it.
CHAT = {
    "faq": "answer_id BIGINT, question STRING, answer STRING, category STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP, variants ARRAY<STRUCT<variant_id: BIGINT, answer_id: BIGINT, variant_text STRING, is_active: BOOLEAN>>".replace("variant_text STRING", "variant_text: STRING"),
    "faq_csv": "idx INT, answer_id BIGINT, category STRING, type STRING, content STRING, answer STRING",
    "rewrite": "id BIGINT, raw_text STRING, normalized_text STRING, is_active BOOLEAN",
    "config": "similarity_threshold DOUBLE, margin_threshold DOUBLE, log_retention_days INT, support_email STRING",
    "chat_user": "id BIGINT, username STRING, full_name STRING, is_active BOOLEAN, created_at TIMESTAMP, role STRING",
    "chat_log": "ask STRING, decistion_type STRING, answer STRING, timestamp STRING",
    "suggestion": "answer_id BIGINT, question STRING, score DOUBLE",
}

#: Allowed values of enumerated columns, and defaults given at creation.
ENUMS = {
    ("news", "tag"): ("news", "workshop", "seminar", "hackathon", "ecotech", "hackday", "cyber-clinic"),
    ("courses", "tag"): ("short-course", "public-lecture"),
    ("cyber_clinic_videos", "source"): ("upload", "external"),
    **{(c, "lang"): ("en", "vi") for c in ("news", "learning_materials", "research_labs", "courses", "solutions")},
    **{(c, "_status"): ("draft", "published") for c in ("news", "learning_materials", "research_labs", "courses", "solutions")},
}
DEFAULTS = {("members", "rank"): 100, **{(c, "lang"): "en" for c in ("news", "learning_materials", "research_labs", "courses", "solutions")}}

#: Collections that keep drafts and versions.
VERSIONED = ("news", "learning_materials", "research_labs", "courses", "solutions")
