"""Dimension tables: rules, success criteria, repair tiers, id aliases, phrase sets.

All of them are small and fixed, so joins with them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rule | standard | criterion | severity | checkpoint.
RULES = """
PDFUA.TITLE|PDF/UA §5.2|2.4.2|Error|07-001
PDFUA.LANG|PDF/UA §5.3|3.1.1|Error|06-001
PDFUA.TAGGED|PDF/UA §5.1|1.3.1|Error|01-001
PDFUA.IMG.ALT|PDF/UA §6.5|1.1.1|Error|13-004
PDFUA.HEADINGS|WCAG Technique PDF9|1.3.1|Error|14-006
PDFUA.FORMS|PDF/UA §6.6|1.3.1|Error|26-001
PDFUA.BOOKMARKS|PDF/UA §6.8|2.4.1|Warning|12-001
PDFBP.DISPLAY_TITLE|PDF/UA Best Practice|2.4.2|Warning|07-001
PDFBP.NO_HEADINGS|WCAG Technique PDF9|2.4.6|Warning|14-003
PDFBP.NONSTD_NO_ALT|PDF/UA §5.4|1.1.1|Warning|01-007
PDFBP.TABLE_SCOPE|PDF/UA §6.6|1.3.1|Warning|15-003
PDFBP.TABLE_HEADERS|PDF/UA §6.6|1.3.1|Error|15-003
PDFBP.FLAT_STRUCTURE|PDF/UA Best Practice|1.3.1|Tip|--
PDFBP.FORMS_DETACHED|PDF/UA Best Practice|1.3.2|Error|26-002
PDFBP.UNDERSCORE_FILL|PDF/UA Best Practice|1.3.1|Warning|--
PDFBP.NAV.TABORDER|PDF/UA Best Practice|2.4.3|Warning|--
PDFBP.TEXT.EXTRACTABLE|PDF/UA §5.1|1.3.1|Error|01-001
PDFBP.ALT_LENGTH|PDF/UA Best Practice|1.1.1|Warning|--
PDFBP.ALT_QUALITY|PDF/UA Best Practice|1.1.1|Warning|--
PDFBP.LANG_VALID|PDF/UA §5.3|3.1.1|Warning|06-002
PDFBP.LINK_TEXT|WCAG Technique PDF13|2.4.4|Warning|--
PDFBP.EMPTY_TAGS|PDF/UA Best Practice|1.3.1|Warning|--
PDFBP.FORMS.DUPLICATE_NAMES|PDF/UA §6.6|1.3.1|Warning|--
PDFBP.FORMS.RADIO_GROUP|WebAIM Forms|1.3.1|Warning|--
PDFBP.LIST_STRUCT|PDF/UA §6.5|1.3.1|Warning|16-003
PDFBP.FIGURE_CAPTION|PDF/UA §6.5|1.3.1|Warning|09-004
PDFBP.ART_TAGS|PDF/UA Best Practice|1.3.1|Warning|--
PDFBP.SECT_NESTING|PDF/UA Best Practice|1.3.1|Tip|--
PDFBP.FORMS.TOOLTIP_QUALITY|WebAIM Forms|4.1.2|Warning|--
PDFUA.METADATA.TITLE|PDF/UA §5.2|2.4.2|Error|07-001
PDFUA.METADATA.LANG|PDF/UA §5.3|3.1.1|Error|06-001
PDFUA.METADATA.LANG.REVIEW|PDF/UA §5.3|3.1.1|Warning|06-001
PDFBP.DISPLAY.DOCTITLE|PDF/UA Best Practice|2.4.2|Warning|07-001
PDFUA.STRUCT.TAGGED|PDF/UA §5.1|1.3.1|Error|01-001
PDFQ.METADATA.PDFUA|PDF/UA §5.1|--|Info|--
PDFUA.STRUCT.NOTREE|PDF/UA §5.1|1.3.1|Error|01-001
PDFUA.FORM.STRUCT|PDF/UA §6.6|1.3.1|Error|26-002
PDFBP.FORM.STRUCT|PDF/UA Best Practice|1.3.1|Warning|26-002
PDFBP.LIST.CONTINUATION|PDF/UA Best Practice|1.3.1|Warning|--
PDFQ.NONSTD.ROLE|PDF/UA §5.4|1.3.1|Info|01-007
PDFBP.HEADING.SKIP|WCAG Technique PDF9|1.3.1|Error|--
PDFUA.TABLE.HEADERS|PDF/UA §6.6|1.3.1|Error|15-003
PDFBP.ORDER.FIGURE|PDF/UA §6.5|1.3.2|Warning|09-004
PDFBP.ORDER.MCID|PDF/UA §6.1|1.3.2|Warning|09-004
PDFQ.ORDER.MANUAL|PDF/UA §6.1|1.3.2|Info|09-004
PDFUA.FORM.TU|PDF/UA §6.6|1.3.1|Error|26-001
PDFBP.FORMS.REQUIRED_LABEL|WebAIM Forms|3.3.2|Warning|--
PDFBP.FORMS.BUTTON_TOOLTIP|WebAIM Forms|4.1.2|Warning|--
PDFBP.FORMS.RADIO_TOOLTIP|WebAIM Forms|1.3.1|Warning|--
PDFBP.FORM.ORPHAN|pypdf docs|1.3.1|Warning|26-002
PDFBP.FORMS.NOACROFORM|PDF/UA §6.6|1.3.1|Info|--
DOCX-META.TITLE|WCAG 2.4.2|2.4.2|Error|--
DOCX-META.LANG|WCAG 3.1.1|3.1.1|Error|--
DOCX-STRUCT.HEADINGS|WCAG 1.3.1|1.3.1|Error|--
DOCX-STRUCT.HEADINGSKIP|WCAG 1.3.1|1.3.1|Error|--
DOCX-IMG.ALT|WCAG 1.1.1|1.1.1|Error|--
DOCX-IMG.ALT_QUALITY|WCAG 1.1.1|1.1.1|Warning|--
DOCX-TABLE.HEADERS|WCAG 1.3.1|1.3.1|Error|--
DOCX-TABLE.MERGE|WCAG 1.3.1|1.3.1|Warning|--
DOCX-LINK.DESCRIPTIVE|WCAG 2.4.4|2.4.4|Warning|--
DOCX-STRUCT.EMPTYPARA|WCAG 1.3.1|1.3.1|Info|--
DOCX-IMG.ALT_FLOAT|WCAG 1.1.1|1.1.1|Error|--
DOCX-LIST.SEMANTIC|WCAG 1.3.1|1.3.1|Warning|--
DOCX-TABLE.NESTED|WCAG 1.3.1|1.3.1|Error|--
DOCX-STRUCT.TOC|WCAG 2.4.5|2.4.5|Warning|--
DOCX-REVIEW.TRACKED|WCAG 1.3.1|1.3.1|Warning|--
DOCX-STRUCT.HDRFTR|WCAG 1.3.2|1.3.2|Info|--
DOCX-STRUCT.FOOTNOTES|WCAG 2.4.1|2.4.1|Info|--
XLSX.META.TITLE|Section 508|2.4.2|Error|--
XLSX.NAV.SHEET_NAMES|Section 508|2.4.2|Warning|--
XLSX.NAV.SHEET_DUP|Section 508|2.4.2|Warning|--
XLSX.NAV.FREEZE_PANES|WebAIM|1.3.1|Info|--
XLSX.TABLE.NAMED|Section 508|1.3.1|Warning|--
XLSX.TABLE.HEADER|Section 508|1.3.1|Error|--
XLSX.LAYOUT.MERGED|WebAIM|1.3.1|Warning|--
XLSX.LAYOUT.SPACING|WebAIM|1.3.1|Info|--
XLSX.LINKS.TEXT|WCAG 2.4.4|2.4.4|Warning|--
XLSX.COLOR.ONLY|WCAG 1.4.1|1.4.1|Warning|--
XLSX.CHART.ALT|WCAG 1.1.1|1.1.1|Error|--
XLSX.IMG.ALT|WCAG 1.1.1|1.1.1|Error|--
XLSX.LAYOUT.HIDDEN|WCAG 1.3.1|1.3.1|Warning|--
XLSX.PROTECT.SHEET|WCAG 2.1.1|2.1.1|Info|--
XLSX.DATA.VALIDATION|WCAG 3.3.2|3.3.2|Warning|--
PPTX.META.TITLE|Section 508|2.4.2|Error|--
PPTX.SLIDE.TITLE|Section 508|2.4.2|Error|--
PPTX.SLIDE.TITLE_DUP|Section 508|2.4.2|Warning|--
PPTX.SLIDE.NOTES|WCAG 1.2.1|1.2.1|Info|--
PPTX.ORDER.TITLE_FIRST|Section 508|1.3.2|Warning|--
PPTX.ORDER.COLUMNS|WCAG 1.3.2|1.3.2|Info|--
PPTX.ORDER.VERIFY|WCAG 1.3.2|1.3.2|Info|--
PPTX.IMG.ALT|WCAG 1.1.1|1.1.1|Error|--
PPTX.IMG.ALT_QUALITY|WCAG 1.1.1|1.1.1|Warning|--
PPTX.TABLE.HEADER|WCAG 1.3.1|1.3.1|Error|--
PPTX.MEDIA.CAPTIONS|WCAG 1.2.2|1.2.2|Warning|--
PPTX.SECTION.NAME|Section 508|2.4.1|Info|--
PPTX.SECTION.DUP|Section 508|2.4.1|Warning|--
PPTX.LINKS.TEXT|WCAG 2.4.4|2.4.4|Warning|--
PPTX.META.LANG|WCAG 3.1.1|3.1.1|Error|--
PPTX.GROUP.ALT|WCAG 1.1.1|1.1.1|Error|--
PPTX.TRANSITION.AUTO|WCAG 2.2.1|2.2.1|Warning|--
PPTX.ANIM.EXCESSIVE|WCAG 2.3.3|2.3.3|Info|--
EPUB-E001|EPUB A11y 1.1|2.4.2|Error|--
EPUB-E002|EPUB A11y 1.1|--|Error|--
EPUB-E003|EPUB A11y 1.1|3.1.1|Error|--
EPUB-E004|EPUB A11y 1.1|2.4.5|Error|--
EPUB-E005|EPUB A11y 1.1|1.1.1|Error|--
EPUB-E006|EPUB A11y 1.1|1.3.2|Error|--
EPUB-E007|EPUB A11y 1.1|--|Error|--
EPUB-W001|EPUB A11y 1.1|--|Warning|--
EPUB-W002|EPUB A11y 1.1|2.4.1|Warning|--
EPUB-W003|EPUB A11y 1.1|2.4.6|Error|--
EPUB-W004|EPUB A11y 1.1|1.3.1|Error|--
EPUB-W005|EPUB A11y 1.1|2.4.4|Warning|--
EPUB-W006|EPUB A11y 1.1|1.4.1|Warning|--
EPUB-T001|EPUB A11y 1.1|--|Info|--
EPUB-T002|EPUB A11y 1.1|--|Info|--
EPUB-T003|EPUB A11y 1.1|--|Info|--
MD-A11Y.LINK.AMBIGUOUS|WCAG 2.4.4|2.4.4|Error|--
MD-A11Y.LINK.BARE_URL|WCAG 2.4.4|2.4.4|Warning|--
MD-A11Y.LINK.FILETYPE|WCAG 2.4.4|2.4.4|Warning|--
MD-A11Y.IMG.ALT_MISSING|WCAG 1.1.1|1.1.1|Error|--
MD-A11Y.IMG.ALT_QUALITY|WCAG 1.1.1|1.1.1|Warning|--
MD-A11Y.HEADING.MULTIPLE_H1|WCAG 1.3.1|1.3.1|Warning|--
MD-A11Y.HEADING.SKIP|WCAG 1.3.1|1.3.1|Error|--
MD-A11Y.HEADING.NO_H1|WCAG 1.3.1|1.3.1|Warning|--
MD-A11Y.TABLE.NO_DESC|WCAG 1.3.1|1.3.1|Warning|--
MD-A11Y.TABLE.EMPTY_HEADER|WCAG 1.3.1|1.3.1|Warning|--
MD-A11Y.EMOJI.HEADING|WCAG 1.3.3|1.3.3|Warning|--
MD-A11Y.EMOJI.CONSECUTIVE|WCAG 1.3.3|1.3.3|Info|--
MD-A11Y.DIAGRAM.MERMAID|WCAG 1.1.1|1.1.1|Error|--
MD-A11Y.DIAGRAM.ASCII|WCAG 1.1.1|1.1.1|Warning|--
"""

# Success criteria and their names.
CRITERIA = """
1.1.1|Non-text Content
1.2.1|Audio-only and Video-only
1.2.2|Captions (Prerecorded)
1.3.1|Info and Relationships
1.3.2|Meaningful Sequence
1.3.3|Sensory Characteristics
1.4.1|Use of Color
1.4.3|Contrast (Minimum)
2.1.1|Keyboard
2.2.1|Timing Adjustable
2.3.3|Animation from Interactions
2.4.1|Bypass Blocks
2.4.2|Page Titled
2.4.3|Focus Order
2.4.4|Link Purpose (In Context)
2.4.5|Multiple Ways
2.4.6|Headings and Labels
3.1.1|Language of Page
3.3.2|Labels or Instructions
4.1.2|Name, Role, Value
"""

# Rule | tier | repair tool ("-": none).
TIERS = """
PDFUA.METADATA.TITLE|1|fix_pdf
PDFUA.METADATA.DISPLAY_TITLE|1|fix_pdf
PDFBP.DISPLAY.DOCTITLE|1|fix_pdf
PDFUA.METADATA.LANG|1|fix_pdf
PDFUA.NAV.TAB_ORDER|1|fix_pdf
PDFBP.NAV.TABORDER|1|fix_pdf
PDFUA.METADATA.PDFUA_ID|1|fix_pdf
PDFQ.METADATA.PDFUA|1|fix_pdf
PDFUA.STRUCTURE.MARKED|1|fix_pdf
PDFUA.FORM.TU|2|fix_pdf
PDFUA.TABLE.HEADERS|3|-
PDFBP.HEADING.SKIP|3|-
DOCX-META.TITLE|1|fix_word
DOCX-META.LANG|1|fix_word
DOCX-META.AUTHOR|1|fix_word
DOCX-TABLE.HEADERS|2|fix_word
DOCX-IMG.ALT|3|-
XLSX.META.TITLE|1|fix_excel
XLSX-META.TITLE|1|fix_excel
XLSX.META.AUTHOR|1|fix_excel
XLSX-META.AUTHOR|1|fix_excel
XLSX-SHEET.NAME|3|-
XLSX-TABLE.PRINT_TITLES|2|fix_excel
XLSX.TABLE.HEADER|2|fix_excel
XLSX-IMG.ALT|3|-
XLSX.IMG.ALT|3|-
PPTX.META.TITLE|1|fix_pptx
PPTX-META.TITLE|1|fix_pptx
PPTX.META.AUTHOR|1|fix_pptx
PPTX-META.AUTHOR|1|fix_pptx
PPTX-SLIDE.TITLE|2|fix_pptx
PPTX.SLIDE.TITLE|2|fix_pptx
PPTX-SLIDE.TITLE_UNIQUE|2|fix_pptx
PPTX-IMG.ALT|3|-
PPTX.IMG.ALT|3|-
EPUB-E001|1|fix_epub
EPUB-E003|1|fix_epub
EPUB-T002|1|fix_epub
EPUB-E006|1|fix_epub
EPUB-E007|1|fix_epub
EPUB-E004|2|fix_epub
EPUB-E005|3|-
EPUB-E009|3|-
EPUB-W003|2|fix_epub
"""

# Scanner rule | the id its fixer knows.
ALIASES = """
PDFBP.DISPLAY.DOCTITLE|PDFUA.METADATA.DISPLAY_TITLE
PDFBP.NAV.TABORDER|PDFUA.NAV.TAB_ORDER
PDFQ.METADATA.PDFUA|PDFUA.METADATA.PDFUA_ID
XLSX.META.TITLE|XLSX-META.TITLE
XLSX.META.AUTHOR|XLSX-META.AUTHOR
XLSX.TABLE.HEADER|XLSX-TABLE.PRINT_TITLES
XLSX.IMG.ALT|XLSX-IMG.ALT
PPTX.META.TITLE|PPTX-META.TITLE
PPTX.META.AUTHOR|PPTX-META.AUTHOR
PPTX.SLIDE.TITLE|PPTX-SLIDE.TITLE
PPTX.IMG.ALT|PPTX-IMG.ALT
EPUB-E009|EPUB-E005
"""

# File type | repair tool.
TYPE_TOOLS = {"pdf": "fix_pdf", "docx": "fix_word", "xlsx": "fix_excel", "pptx": "fix_pptx", "epub": "fix_epub"}
# Rules that a text generator lifts from tier 3 to tier 2.
ALT_RULES = ("DOCX-IMG.ALT", "XLSX-IMG.ALT", "XLSX.IMG.ALT", "PPTX-IMG.ALT", "PPTX.IMG.ALT", "EPUB-E005", "EPUB-E009", "PDFUA.IMG.ALT")
# Rules about reading order.
READING_ORDER = ("PDFBP.ORDER.FIGURE", "PDFBP.ORDER.MCID", "PDFQ.ORDER.MANUAL", "PDFBP.FORMS_DETACHED", "PPTX.ORDER.TITLE_FIRST", "PPTX.ORDER.COLUMNS", "PPTX.ORDER.VERIFY")
# Further rules that need a person.
MANUAL = (*READING_ORDER, "DOCX-LIST.SEMANTIC")
# File types, in report order.
TYPES = ("pdf", "docx", "xlsx", "pptx", "epub", "md")
# Weak link texts of each format.
VAGUE_LINKS = {
    "md": ("here", "click here", "read more", "learn more", "more", "more info", "link", "details", "info", "go", "see more", "continue", "start", "download", "view", "open", "submit", "this", "that"),
    "epub": ("click here", "here", "more", "read more", "learn more", "link", "more info", "details", "this", "this link", "go", "continue"),
    "xlsx": ("click here", "here", "link", "more", "read more", "learn more", "go", "this", "url", "http", "https", "www", "details", "info"),
    "docx": ("click here", "here", "read more", "learn more", "more", "link", "more info", "this", "download", "go", "view", "see here", "details", "info"),
    "pptx": ("click here", "here", "read more", "learn more", "more", "link", "more info", "this", "details", "info", "go", "view", "see here", "download", "url"),
}
# Beginnings of weak Markdown link texts, generic alternative texts, download extensions.
VAGUE_STARTS = ("click here to", "read more about", "learn more about", "here to", "see more")
GENERIC_ALT = ("image", "screenshot", "photo", "picture", "img", "figure", "graphic", "icon", "logo", "banner", "diagram")
GENERIC_ALT_PPTX = ("image", "picture", "photo", "graphic", "chart", "figure", "screenshot", "image1", "picture1")
DOWNLOADS = (".pdf", ".zip", ".docx", ".xlsx", ".pptx", ".epub", ".tar", ".gz")
# Generic sheet and section names, generic tooltips.
GENERIC_SHEETS = ("sheet1", "sheet2", "sheet3", "sheet4", "sheet5", "tab1", "tab2", "tab3", "page1", "page2")
GENERIC_SECTIONS = ("untitled section", "section 1", "section 2", "section 3", "section 4", "section 5", "default section", "new section")
GENERIC_TOOLTIPS = ("text", "field", "input", "button", "check", "radio", "select", "combo", "choice", "option", "entry", "box", "value", "form", "data", "item", "edit")
# Tags of the standard, and those that should hold text.
STANDARD_TAGS = ("Document", "Part", "Sect", "Div", "Caption", "BlockQuote", "NonStruct", "TOC", "TOCI", "Index", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot", "Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Figure", "Formula", "Form", "Link", "Annot", "Ruby", "Warichu", "RB", "RT", "RP", "WT", "WP", "Artifact")
TEXT_TAGS = ("P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "Span", "LI", "LBody", "Label", "Caption", "TD", "TH", "Figure", "InlineShape", "Textbox", "BlockQuote", "Quote", "Note")


def _rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip().split("\n")]


def rule_dim(spark: SparkSession) -> DataFrame:
    rows = [(*r, r[0] in READING_ORDER, r[0] in MANUAL) for r in _rows(RULES)]
    return spark.createDataFrame(rows, "rule string, standard string, criterion string, catalog_severity string, checkpoint string, reading_order boolean, manual boolean")


def criterion_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_rows(CRITERIA), "criterion string, name string")


def tier_dim(spark: SparkSession, generator: bool = False) -> DataFrame:
    """rule, tier, tool, fixer_rule; with a text generator alternative-text rules rise to tier 2."""
    prefix = {"DOCX": "fix_word", "XLSX": "fix_excel", "PPTX": "fix_pptx", "PDF": "fix_pdf", "EPUB": "fix_epub"}
    alias = dict(_rows(ALIASES))
    rows = []
    for rule, tier, tool in _rows(TIERS):
        tier, tool = int(tier), None if tool == "-" else tool
        if generator and rule in ALT_RULES and tier == 3:
            tier, tool = 2, tool or next(v for k, v in prefix.items() if rule.startswith(k))
        rows.append((rule, tier, tool, alias.get(rule, rule)))
    return spark.createDataFrame(rows, "rule string, tier int, tool string, fixer_rule string")
