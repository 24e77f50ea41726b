"""Column types of the audit's tables, as DDL; nothing is inferred."""

HREFLANG = "array<struct<lang:string,url:string>>"
LINK = (
    "struct<type:string,url:string,raw:string,anchor:string,alt:string,rel:string,target:string,nofollow:boolean,path_type:string,"
    "elem_path:string,position:string,lang:string,width:string,height:string,no_alt_attr:boolean,origin:string>"
)
HEAD = "struct<invalid_elements_in_head:array<string>,missing_head:boolean,multiple_head:boolean,missing_body:boolean,multiple_body:boolean,body_before_html:boolean,head_not_first:boolean>"
FACTS = (
    "struct<titles:array<string>,titles_outside_head:int,descriptions:array<string>,descriptions_outside_head:int,keywords:array<string>,"
    "h1s:array<string>,h2s:array<string>,heading_levels:array<int>,h1_alt_text:boolean,meta_robots:array<string>,meta_robots_outside_head:int,"
    "x_robots_tag:array<string>,meta_refresh:string,meta_refresh_url:string,canonical_html:array<string>,canonical_http:array<string>,"
    "canonical_outside_head:int,canonical_invalid_attrs:array<string>,next_html:array<string>,prev_html:array<string>,next_http:array<string>,"
    f"prev_http:array<string>,hreflang_html:{HREFLANG},hreflang_http:{HREFLANG},hreflang_outside_head:int,amp_links:array<string>,"
    "mobile_alternates:array<string>,base_href:string,lang:string,is_amp:boolean,has_viewport:boolean,has_charset:boolean,has_amp_script:boolean,"
    "forms:array<struct<action:string>>,word_count:int,text_ratio:double,avg_words_per_sentence:double,flesch:double,content_text:string,"
    f"hash:string,head:{HEAD},links:array<{LINK}>>"
)
STRUCTURED = "struct<formats:array<string>,types:array<string>,parse_errors:array<string>,recovered:array<string>,errors:array<string>,warnings:array<string>>"
JSDIFF = (
    "struct<rendered_word_count:int,word_count_change:int,title_changed:boolean,description_changed:boolean,h1_changed:boolean,canonical_changed:boolean,"
    "noindex_only_raw:boolean,rendered_title:string,rendered_canonical:string,js_links:int,console_errors:array<string>,structured_js_only:array<string>>"
)
PAGES = (
    "url string, scope string, state string, depth int, status_code int, status string, content_type string, http_version string, response_time_ms bigint, "
    "size bigint, fetch_error string, redirect_url string, redirect_type string, matched_robots_line int, headers map<string,string>, indexable boolean, "
    "indexability_status string, inlinks int, discovered_from string, outside_start_folder boolean, duplicate_of string, link_score double, "
    "unique_inlinks int, unique_outlinks int, closest_similarity double, near_dup_count int, "
    f"facts {FACTS}, structured {STRUCTURED}, jsdiff {JSDIFF}"
)
ISSUES = "url string, issue string, detail string"
