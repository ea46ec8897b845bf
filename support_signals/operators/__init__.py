"""DataFrame -> DataFrame operators of the ticket-trend domain."""
