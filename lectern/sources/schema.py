"""Silver tables: facts that extractors give and rules read. Pages count from 1; ``ord`` is reading order."""

SCHEMAS: dict[str, str] = {
    "doc": "doc_id BIGINT, path STRING, file STRING, type STRING, size_bytes BIGINT, access_ok BOOLEAN, skip_reason STRING, title STRING, author STRING, lang STRING, info_lang STRING, pages INT, tagged BOOLEAN, mark_info_present BOOLEAN, display_doc_title BOOLEAN, viewer_prefs_present BOOLEAN, outlines_present BOOLEAN, acroform_present BOOLEAN, tree_present BOOLEAN, xmp STRING, toc_present BOOLEAN, tracked_n INT, slide_width_emu BIGINT, slide_height_emu BIGINT",
    "struct_node": "doc_id BIGINT, node_id INT, parent_id INT, ord INT, depth INT, preorder INT, post INT, tag STRING, page INT, alt STRING, actual_text STRING, attrs MAP<STRING,STRING>, mcids ARRAY<INT>, has_objr BOOLEAN, k_null BOOLEAN",
    "role_map": "doc_id BIGINT, tag STRING, maps_to STRING",
    "form_field": "doc_id BIGINT, ord INT, name STRING, ft STRING, ff INT, tooltip STRING, kids_n INT",
    "widget": "doc_id BIGINT, page INT, ord INT, t STRING",
    "pdf_page": "doc_id BIGINT, page INT, tabs STRING, text STRING, extract_ok BOOLEAN",
    "mcid_tree": "doc_id BIGINT, page INT, pos INT, mcid INT",
    "mcid_paint": "doc_id BIGINT, page INT, pos INT, mcid INT",
    "md_text": "doc_id BIGINT, text STRING",
    "html_el": "doc_id BIGINT, content_doc STRING, ord INT, parent_ord INT, post INT, el STRING, attrs MAP<STRING,STRING>, inner_text STRING",
    "epub_pkg": "doc_id BIGINT, version STRING, unique_identifier STRING, title STRING, language STRING, creator STRING, description STRING, identifiers ARRAY<STRUCT<id:STRING,text:STRING>>, metas ARRAY<STRUCT<property:STRING,text:STRING>>, nav_present BOOLEAN, nav_types ARRAY<STRING>, ncx_points INT, spine_present BOOLEAN, manifest_present BOOLEAN",
    "epub_item": "doc_id BIGINT, item_id STRING, href STRING, media_type STRING, properties STRING, part STRING",
    "epub_spine": "doc_id BIGINT, ord INT, idref STRING",
    "para": "doc_id BIGINT, ord INT, style STRING, text STRING, has_numpr BOOLEAN",
    "drawing": "doc_id BIGINT, ord INT, kind STRING, descr STRING, title STRING, has_docpr BOOLEAN",
    "doc_table": "doc_id BIGINT, table_no INT, has_header BOOLEAN, has_merged BOOLEAN, nested_n INT",
    "hyperlink": "doc_id BIGINT, ord INT, container STRING, text STRING, url STRING",
    "note": "doc_id BIGINT, ord INT, kind STRING, note_type STRING, text STRING",
    "hdrftr": "doc_id BIGINT, section INT, kind STRING, linked BOOLEAN, text STRING",
    "sheet": "doc_id BIGINT, ord INT, name STRING, state STRING, max_row INT, max_col INT, frozen BOOLEAN, merged_n INT, protected BOOLEAN, hidden_rows INT, hidden_cols INT, colour_fill BOOLEAN",
    "sheet_row": "doc_id BIGINT, sheet STRING, row_no INT, empty_first19 BOOLEAN",
    "xl_table": "doc_id BIGINT, sheet STRING, name STRING, header_row_count INT",
    "validation": "doc_id BIGINT, sheet STRING, ord INT, prompt_title STRING, prompt STRING",
    "xl_drawing": "doc_id BIGINT, kind STRING, ord INT, descr STRING",
    "slide": "doc_id BIGINT, slide_no INT, title STRING, has_title_shape BOOLEAN, notes STRING, adv_tm STRING, animated BOOLEAN",
    "shape": "doc_id BIGINT, slide_no INT, ord INT, shape_type INT, is_title BOOLEAN, name STRING, text STRING, descr STRING, decorative BOOLEAN, left_emu BIGINT, top_emu BIGINT, width_emu BIGINT, has_table BOOLEAN, first_row BOOLEAN",
    "run_link": "doc_id BIGINT, slide_no INT, ord INT, text STRING, url STRING",
    "deck_section": "doc_id BIGINT, ord INT, name STRING",
    "image": "doc_id BIGINT, image_id INT, page INT, mime STRING, width INT, height INT, content BINARY, existing_alt STRING, context STRING",
    "alt_candidate": "doc_id BIGINT, image_id INT, ord INT, model STRING, text STRING, error_type STRING",
}

FINDING = "family STRING, scanner STRING, doc BIGINT, type STRING, rule STRING, severity STRING, confidence STRING, wcag STRING, checkpoint STRING, page INT, line INT, element STRING, n BIGINT, message STRING, fix STRING, ord BIGINT"
