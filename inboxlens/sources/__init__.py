"""Sources and sinks: message cache, sender table, mailbox listing."""

from inboxlens.sources.cache import load_cache, response_of, save_cache
from inboxlens.sources.listing import bounded_listing
from inboxlens.sources.messages_io import load_messages, save_messages
from inboxlens.sources.senders_io import load_senders, save_senders

__all__ = ["load_cache", "save_cache", "response_of", "load_senders", "save_senders", "bounded_listing",
           "load_messages", "save_messages"]
