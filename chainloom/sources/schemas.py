"""Column layouts of the files and tables the engine reads and writes. TSV files have no header."""

from __future__ import annotations

#: A browser log event in the fields that anything reads.
HEADERS = "map<string,string>"
MESSAGE = f"""struct<message:struct<method:string,params:struct<
  requestId:string,frameId:string,parentFrameId:string,loaderId:string,type:string,documentURL:string,url:string,reason:string,
  request:struct<url:string,urlFragment:string,method:string,headers:{HEADERS}>,
  initiator:struct<type:string,url:string,stack:struct<callFrames:array<struct<url:string>>>>,
  redirectResponse:struct<url:string,status:int,headers:{HEADERS}>,
  response:struct<url:string,status:int,headers:{HEADERS}>>>>"""

ENTRIES = "domain string, label string, source string, end_url string"
CHAINS = ENTRIES + ", urls string, methods string, hops int, iframe string, download string, download_url string"
INITIATORS = "domain string, label string, source string, hop_url string, hop_type string, hop_ts long, init_url string, init_type string, init_ts long"
NODES = "domain string, label string, source string, node_id string, url string, parent_id string, parent_source string, resource_type string, ts long, children string"
MANIFEST = "domain string, sample_tag string, start_time long, end_time long, cost_time long, start_url string, end_url string, end_title string"
FAILURES = "domain string, exception string"
TAGS = "tag_id string, visible int, rects string, outer_html string"
TYPED_TAGS = "tag_id string, tag_type string, visible int, rects string, outer_html string"

#: The 24 message-graph features in the order of the feature file.
HMG_FEATURES = (
    "node_cnt status_40x_ratio referer_ratio ip_ratio post_ratio redirect_cnt cross_domain_cnt max_path_len longest_path_len component_cnt isolate_ratio "
    "mpr_node_sn same_pr_domain_ratio mpr_url_len mpr_url_path_depth mpr_url_query_len mpr_url_query_cnt mpr_node_pr mdc_node_dc mdc_node_sn "
    "same_dc_domain_ratio mdc_closeness max_betweenness nonzero_betweenness_cnt"
).split()
HMG = "sample string, label string, " + ", ".join(f"{n} double" for n in HMG_FEATURES)
ROC = "fp double, tp double, threshold double"

#: Flat log events, requests with their parents, and tree nodes.
LOG = """sample_id string, start_url string, seq long, ts long, method string, request_id string, frame_id string, parent_frame_id string, loader_id string,
  resource_type string, document_url string, url string, url_fragment string, http_method string, request_headers map<string,string>,
  initiator_type string, initiator_url string, has_stack boolean, call_urls array<string>, redirect_url string, redirect_status int, redirect_headers map<string,string>,
  status int, response_headers map<string,string>, reason string"""
REQUESTS = "sample_id string, seq long, request_url string, resource_type string, parent_url string, parent_source string, ts long, frame_id string"
TREE = """sample_id string, seq long, node_seq int, url string, url_fragment string, parent_seq int, parent_source string, resource_type string, ts long,
  depth int, path array<int>, path_ord array<int>"""
