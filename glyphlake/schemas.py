"""Explicit schemas of the dictionary's tables; nothing is inferred."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "character_summary": "codepoint string, character string, block string, radical_idx bigint, total_strokes bigint, residual_strokes bigint, primary_ids string, ids_top_idc string",
    "radicals": "radical_idx bigint, char string, name_ko string, strokes bigint",
    "characters_ids": "codepoint string",
    "characters_structure": "codepoint string, radical_idx bigint, total_strokes bigint",
    "characters_core": "codepoint string, character string, block string",
    "character_readings": "codepoint string, reading_type string, value string",
    "character_hunum": "codepoint string, seq bigint, jahun string, dokeum string",
    "character_meanings": "codepoint string, language string, value string",
    "variant_edges": "source_codepoint string, target_codepoint string, target_character string, relation string, relation_category string",
    "variant_family": "codepoint string, component_size bigint, representative string, family_members_json string",
    "character_grades": "codepoint string, kr_grade string, kr_education string, cn_tonggyong bigint, jp_grade bigint, jp_freq bigint, jp_jlpt bigint, unihan_core string",
    "fts_search": "codepoint string, hanja string, body string",
    "anchors": "idx int, embedding array<float>",
    "class_index": "codepoint string, idx int",
}
READING_TYPES = ("mandarin", "cantonese", "onyomi", "kunyomi", "vietnamese")
MEANING_LANGUAGES = ("ko", "en")
