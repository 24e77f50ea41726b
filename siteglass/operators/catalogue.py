"""The checks' catalogue: a dimension table of id, tab, severity and priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, tab, severity and priority of each check.
CHECKS = """
internal_no_response response_codes issue high
internal_client_error response_codes issue high
internal_server_error response_codes issue high
internal_blocked_robots response_codes warning high
internal_redirect response_codes warning low
internal_redirect_meta_refresh response_codes warning low
external_no_response response_codes warning low
external_client_error response_codes warning low
external_server_error response_codes warning low
security_http_url security issue high
security_mixed_content security issue high
security_form_url_insecure security issue high
security_form_on_http security issue high
security_unsafe_cross_origin security warning low
security_protocol_relative security warning low
security_missing_hsts security warning low
security_missing_csp security warning low
security_missing_content_type_options security warning low
security_missing_x_frame_options security warning low
security_missing_referrer_policy security warning low
url_uppercase url warning low
url_underscores url opportunity low
url_non_ascii url warning low
url_parameters url warning low
url_multiple_slashes url issue low
url_contains_space url issue low
url_repetitive_path url warning low
url_ga_params url warning low
url_over_length url opportunity low
title_missing page_titles issue high
title_duplicate page_titles opportunity medium
title_over_chars page_titles opportunity medium
title_below_chars page_titles opportunity medium
title_over_pixels page_titles opportunity medium
title_below_pixels page_titles opportunity medium
title_same_as_h1 page_titles opportunity low
title_multiple page_titles issue high
title_outside_head page_titles issue high
description_missing meta_description opportunity low
description_duplicate meta_description opportunity low
description_over_chars meta_description opportunity low
description_below_chars meta_description opportunity low
description_over_pixels meta_description opportunity low
description_below_pixels meta_description opportunity low
description_multiple meta_description issue medium
description_outside_head meta_description issue medium
keywords_multiple meta_keywords warning low
h1_missing h1 issue medium
h1_duplicate h1 opportunity low
h1_over_chars h1 opportunity low
h1_multiple h1 warning medium
h1_non_sequential h1 warning low
h2_missing h2 warning low
h2_duplicate h2 opportunity low
h2_over_chars h2 opportunity low
h2_multiple h2 warning low
h2_non_sequential h2 warning low
content_low_word_count content opportunity medium
content_exact_duplicate content issue high
content_lorem_ipsum content warning high
content_soft_404 content warning high
content_readability_difficult content opportunity low
content_readability_very_difficult content opportunity low
image_missing_alt images issue low
image_alt_over_chars images opportunity low
image_over_size images opportunity medium
canonical_missing canonicals warning medium
canonical_canonicalised canonicals warning high
canonical_multiple canonicals warning low
canonical_multiple_conflicting canonicals issue high
canonical_relative canonicals warning low
canonical_outside_head canonicals issue high
canonical_non_indexable_target canonicals issue high
directive_noindex directives warning high
directive_nofollow directives warning high
directive_none directives warning high
directive_outside_head directives issue high
links_high_internal_outlinks links warning low
links_high_external_outlinks links warning low
links_no_internal_outlinks links warning high
links_internal_nofollow_outlinks links warning low
links_non_descriptive_anchor links opportunity low
links_no_anchor_text links opportunity low
links_to_localhost links issue high
links_high_crawl_depth links opportunity medium
redirect_chain response_codes warning medium
redirect_loop response_codes issue high
canonical_chain canonicals warning medium
content_near_duplicate content warning medium
hreflang_non_200 hreflang issue high
hreflang_missing_return hreflang issue high
hreflang_invalid_code hreflang issue high
hreflang_missing_self_reference hreflang warning low
hreflang_missing_x_default hreflang warning low
pagination_non_200 pagination issue high
pagination_sequence_error pagination issue low
sitemap_orphan sitemaps issue medium
sitemap_non_indexable sitemaps issue medium
sitemap_in_multiple sitemaps warning low
sitemap_not_in_sitemap sitemaps issue medium
sitemap_nested_as_url sitemaps warning medium
structured_missing structured_data opportunity low
structured_parse_error structured_data issue high
structured_invalid_recovered structured_data warning medium
structured_validation_error structured_data issue high
structured_validation_warning structured_data opportunity low
js_noindex_only_raw javascript issue high
js_canonical_mismatch javascript issue high
js_title_updated javascript warning medium
js_h1_updated javascript warning medium
js_contains_links javascript warning medium
js_structured_data_only javascript warning medium
js_console_errors javascript warning low
validation_missing_head validation issue high
validation_multiple_head validation issue high
validation_missing_body validation issue high
validation_multiple_body validation issue high
validation_body_before_html validation warning high
validation_head_not_first validation warning high
validation_invalid_head_elements validation warning high
validation_document_over_2mb validation issue high
viewport_missing mobile issue high
charset_missing validation warning low
html_lang_missing validation warning low
image_missing_size_attributes images opportunity low
links_outlinks_to_redirect links opportunity low
links_outlinks_to_broken links issue medium
redirect_broken response_codes issue high
canonical_to_redirect canonicals issue medium
hreflang_outside_head hreflang issue medium
security_insecure_cookie security warning low
links_nofollow_inlinks_only links warning medium
links_only_non_indexable_inlinks links warning low
canonical_unlinked canonicals warning low
amp_missing_canonical amp issue high
amp_missing_viewport amp issue high
amp_missing_charset amp issue high
amp_missing_script amp issue high
amp_missing_return_link amp issue high
amp_indexable amp warning high
directive_noimageindex directives issue low
directive_unavailable_after directives warning medium
directive_nosnippet directives warning low
directive_notranslate directives warning low
directive_noodp directives warning low
directive_noydir directives warning low
pagination_not_in_anchor pagination issue high
pagination_non_indexable pagination warning high
pagination_multiple pagination issue low
hreflang_multiple_entries hreflang issue high
hreflang_not_using_canonical hreflang issue high
links_uncrawlable_outlinks links warning high
links_follow_nofollow_inlinks links warning low
url_internal_search url warning low
canonical_contains_fragment canonicals issue high
canonical_invalid_attribute canonicals issue high
validation_resource_over_2mb validation issue high
js_description_updated javascript warning medium
image_missing_alt_attribute images issue low
h1_alt_text h1 warning low
pagination_loop pagination issue low
pagination_unlinked pagination issue medium
hreflang_inconsistent_return hreflang issue high
hreflang_non_canonical_return hreflang issue high
hreflang_noindex_return hreflang issue high
hreflang_unlinked hreflang issue medium
sitemap_over_50k sitemaps issue high
llms_txt_missing llms_txt opportunity low
llms_txt_invalid_format llms_txt issue medium
llms_txt_missing_summary llms_txt warning low
llms_txt_malformed_link_list llms_txt warning low
llms_full_txt_missing llms_txt opportunity low
llms_txt_broken_link llms_txt issue high
llms_txt_link_non_indexable llms_txt warning medium
llms_txt_link_unverified llms_txt warning low
"""


def entries() -> list[tuple[str, str, str, str]]:
    """(id, tab, severity, priority) of each check."""
    return [tuple(line.split()) for line in CHECKS.strip().splitlines()]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), "issue string, tab string, severity string, priority string")
